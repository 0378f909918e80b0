"""Mixing rows whose ids are null or repeat: targets are met row by row, and no range holds them all."""

from __future__ import annotations

import os
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_targets_are_met_row_by_row(spark, ids):
    r = random.Random(3)
    rows = []
    for k in range(1200):
        i = {"null": None, "one": 7, "few": k % 3 or None}[ids]
        rows.append((i, "same text of five words" if k % 2 else " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(1, 9))), "a" if k < 1000 else "b"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit("clash")).repartition(5)
    first, again = (sorted(map(tuple, mixing.mix(docs).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == 1200
    sizes = {s: sum(len(WORD.findall(t)) for _, t, x in rows if x == s) for s in "ab"}
    for s in "ab":
        own = [x for x in mixing.mix(docs).where(F.col("source") == s).collect()]
        assert {x["source_size"] for x in own} == {sizes[s]}
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 4.5  # half a document
        assert all(x["copies"] <= 3 for x in own)
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    words = taken.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {x["source"]: x["n"] for x in words.collect()} == {s: sum(x["taken"] for x in mixing.mix(docs).where(F.col("source") == s).collect()) for s in "ab"}


def test_ranges_of_null_ids_are_of_like_size(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("source"), F.lit(0.5).alias("key"), F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("place"), F.lit(3).alias("size"))
    loads = [x["count"] for x in mixing.ranges(rows).groupBy("part").count().collect()]
    assert len(loads) > 4 and max(loads) <= 4 * sum(loads) / len(loads)


def test_words_are_counted(spark):
    texts = ["", None, "  ", " a", "a ", "a b  c", "\x0b\x1c x\x85y \n", "\U0001f600 \U0001f600x", "x$1 \\ y", "\t\n", "\r\na\u00a0b\x0c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(WORD.findall(t or "")) for t in texts]


LONG = """
from pyspark.sql import SparkSession, functions as F
from weftline.llm import mixing
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("WORDS", spark.range(1).select(mixing.word_count(F.repeat(F.lit("w "), (F.col("id") + 16_000_000).cast("int"))).alias("n")).first()["n"])
"""


def test_a_very_long_text_needs_little_memory():
    """A text of 32 MB is counted in a heap of 600 MB."""
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    env = {k: v for k, v in env.items() if k != "PYSPARK_GATEWAY_PORT"}
    said = subprocess.run([sys.executable, "-c", LONG], env=env, capture_output=True, text=True, timeout=200)
    assert "WORDS 16000000" in said.stdout, said.stderr[-2000:]
