"""Dirty CSV and JSON files: sniffed delimiters and encodings, differing headers merged, every line accounted for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", ";", "\t", "|")
#: Bytes at the head of a file that are looked at.
HEAD = 1 << 14
BAD = "malformed"
_LEAST = -(1 << 63)


def sniff(head: bytes) -> tuple[str, str, list[str]]:
    """(encoding, delimiter, columns) from the head of a CSV file: byte order marks, then valid UTF-8, else Latin-1; the delimiter that gives the first lines the same number of fields, and the most."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            text, encoding = head[len(mark) :].decode(name, "ignore"), name
            break
    else:
        try:
            text, encoding = head.decode("utf-8"), "UTF-8"
        except UnicodeDecodeError as e:
            cut_off = len(head) >= HEAD and e.start >= len(head) - 3  # the head ends inside a character
            encoding = "UTF-8" if cut_off else "ISO-8859-1"
            text = head.decode(encoding, "ignore")
    lines = [x for x in text.splitlines()[:20] if x.strip()]
    if not lines:
        return encoding, ",", []

    def fit(d: str) -> tuple:
        n = lines[0].count(d)
        return n > 0 and sum(x.count(d) == n for x in lines) / len(lines), n

    best = max(DELIMITERS, key=fit)
    return encoding, best, [c.strip().strip('"') for c in lines[0].split(best)]


def _heads(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, encoding, delimiter, columns) of every file; only heads go to Python."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    heads = files.select("path", F.substring("content", 1, HEAD).alias("head"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [sniff(bytes(h)) for h in pdf["head"]]
            yield pd.DataFrame({"path": pdf["path"], "encoding": [t[0] for t in told], "delimiter": [t[1] for t in told], "columns": [t[2] for t in told]})

    return heads.mapInPandas(run, "path string, encoding string, delimiter string, columns array<string>")


def read_csv(spark: SparkSession, path: str, schema: str, glob: str = "*.csv") -> DataFrame:
    """All rows of CSV files below ``path`` by the columns of ``schema``, with ``malformed``: the line where it doesn't fit, else null.

    Files of one encoding, delimiter and header are read together; columns are matched by name, whatever their order:
    those that a file lacks are null, others are left out. A line with too few or too many fields, or with a field
    that isn't of its type, is malformed and keeps what could be read. Blank lines are no rows. The driver holds one
    line for each layout of files.
    """
    wanted = T.StructType.fromDDL(schema)
    layouts = _heads(spark, path, glob).groupBy("encoding", "delimiter", "columns").agg(F.collect_list("path").alias("paths")).collect()
    parts = []
    for g in layouts:
        if not g["columns"]:
            continue
        kinds = {f.name: f.dataType for f in wanted}
        own = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in g["columns"]] + [T.StructField(BAD, T.StringType())])
        rows = spark.read.schema(own).options(header=True, sep=g["delimiter"], encoding=g["encoding"], mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(g["paths"])
        rows = rows.where(F.xxhash64(*[f"`{c}`" for c in g["columns"]]) >= _LEAST)  # true: every field is parsed, whatever columns are asked for
        parts.append(rows.select(*[F.col(f"`{c}`") if c in g["columns"] else F.lit(None).cast(kinds[c]).alias(c) for c in kinds], BAD))
    empty = spark.createDataFrame([], T.StructType([*wanted.fields, T.StructField(BAD, T.StringType())]))
    return reduce(DataFrame.unionByName, parts) if parts else empty


def read_json(spark: SparkSession, path: str, schema: str | None = None, glob: str = "*.json") -> DataFrame:
    """All lines of JSON files below ``path``, with ``malformed`` as above and ``file``. Without ``schema`` that of all files together is found first, in a pass of its own.

    Lines are parsed whole whatever columns are asked for, so a line is malformed or not for every reader.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if schema is None:
        kept = [f for f in reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path).schema if f.name != BAD]
    else:
        kept = list(T.StructType.fromDDL(schema))
    own = T.StructType([*kept, T.StructField(BAD, T.StringType())])
    lines = reader.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    return lines.select("r.*", "file")


def account(rows: DataFrame, by: str | None = None) -> DataFrame:
    """(rows, good, malformed), of all rows or for each value of ``by``."""
    measures = [F.count("*").alias("rows"), F.count_if(F.col(BAD).isNull()).alias("good"), F.count(BAD).alias("malformed")]
    return rows.groupBy(by).agg(*measures) if by else rows.agg(*measures)
