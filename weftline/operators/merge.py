"""Merging in DataFrame operations: votes by exact value, longest value, unions, agreement, reliability, confidence.

Records have url, engine_id, engine_rank, success, warnings and the fields. Ties go by engine_rank.
The similarity-clustered vote is in merge_fold; everything here is built-in aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text


def weight(engine: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in C.ENGINE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(table, engine), F.lit(C.DEFAULT_WEIGHT))


def importance(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in C.FIELD_IMPORTANCE.items() for x in kv])
    return F.coalesce(F.element_at(table, field), F.lit(C.DEFAULT_IMPORTANCE))


def long_form(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(url, engine_id, engine_rank, field, value) of successful records' non-empty fields."""
    good = records.where("success")
    rows = good.unpivot(["url", "engine_id", "engine_rank"], list(fields), "field", "value")
    return rows.where(F.coalesce(F.col("value") != "", F.lit(False)))


def vote_exact(values: DataFrame) -> DataFrame:
    """(url, field, winner, agreement): the normalised value with the largest weight, as its first engine wrote it."""
    v = values.withColumn("norm", text.normal(F.col("value"))).withColumn("w", weight(F.col("engine_id")))
    per = v.groupBy("url", "field", "norm").agg(F.sum("w").alias("w"), F.min(F.struct("engine_rank", "value")).alias("first"))
    top = F.max(F.struct(F.round("w", 6).alias("w"), (-F.col("first.engine_rank")).alias("r"), F.col("first.value").alias("value"))).alias("t")
    return per.groupBy("url", "field").agg(top, F.sum("w").alias("total")).select("url", "field", F.col("t.value").alias("winner"), F.round(F.col("t.w") / F.col("total"), 3).alias("agreement"))


def conflicts(values: DataFrame) -> DataFrame:
    """(url, field, n): fields with more than one distinct value, 'unknown' aside."""
    v = values.withColumn("norm", text.normal(F.col("value"))).where("norm NOT IN ('', 'unknown')")
    return v.groupBy("url", "field").agg(F.countDistinct("norm").alias("n")).where("n > 1")


def contributions(values: DataFrame) -> DataFrame:
    rows = values.groupBy("url", "field").agg(F.array_sort(F.collect_list(F.struct("engine_rank", "engine_id"))).alias("e"))
    return rows.select("url", "field", F.array_join(F.transform("e", lambda x: x["engine_id"]), ",").alias("engines"))


def longest_value(records: DataFrame, field: str, tie: str | None = None) -> DataFrame:
    """(url, value, agreement): the longest value and the weight share of those that hold half of its words.

    Records of one engine with values of one length go by the column ``tie``, the least first, where one is given.
    """
    order = [] if tie is None else [(-F.col(tie)).alias("p")]
    v = records.where(F.col("success") & (F.coalesce(F.col(field), F.lit("")) != "")).select("url", (-F.col("engine_rank")).alias("r"), *order, F.col(field).alias("value"), weight(F.col("engine_id")).alias("w"))
    g = v.groupBy("url").agg(F.max(F.struct(F.char_length("value").alias("n"), "r", *(["p"] if order else []), "value")).alias("best"), F.collect_list(F.struct("value", "w")).alias("all"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    g = g.withColumn("bw", words(F.col("best.value")))
    agreeing = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.when(F.size(F.array_intersect(F.col("bw"), words(x["value"]))) >= 0.5 * F.size("bw"), x["w"]).otherwise(0.0))
    total = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["w"])
    return g.select("url", F.col("best.value").alias("value"), F.round(agreeing / total, 3).alias("agreement"))


def union_links(records: DataFrame, field: str = "links") -> DataFrame:
    """(url, href, engine_id): each target once, with the first engine that found it."""
    rows = records.where("success").select("url", "engine_id", "engine_rank", F.posexplode(field).alias("pos", "href"))
    first = rows.groupBy("url", "href").agg(F.min(F.struct("engine_rank", "pos", "engine_id")).alias("f"))
    return first.select("url", "href", F.col("f.engine_id").alias("engine_id"))


def list_agreement(records: DataFrame, field: str = "links") -> DataFrame:
    w = weight(F.col("engine_id"))
    got = F.sum(F.when(F.size(field) > 0, w).otherwise(0.0))
    return records.where("success").groupBy("url").agg(F.round(got / F.sum(w), 3).alias("agreement"))


def reliability(records: DataFrame) -> DataFrame:
    """(url, reliability): share of successes less the penalty for damaging warnings."""
    bad = F.size(F.filter("warnings", lambda w: text.rx(w, C.RELIABILITY_PENALTY)))
    ok = F.avg(F.col("success").cast("int"))
    return records.groupBy("url").agg(F.round(ok * (1 - F.least(0.04 * F.sum(bad), F.lit(0.25))), 3).alias("reliability"))


def title_quality(title: Column, url: Column, language: Column) -> Column:
    t = F.trim(title)
    checks = [F.char_length(t).between(10, 120), ~text.has_noise_word(t), ~F.lower(t).isin("") & (F.lower(t) != F.lower(url)), ~F.coalesce(language, F.lit("")).isin("", "unknown")]
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).otherwise(F.round(sum(c.cast("int") for c in checks) / 4.0, 3))


def confidence(agreement: Column, quality: Column, reliability_: Column) -> Column:
    return F.round(0.5 * agreement + 0.3 * quality + 0.2 * reliability_, 3)
