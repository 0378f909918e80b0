"""Joins that Spark has no keyword for, in equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last row of ``right`` that has the same ``by`` and is not after ``on``.

    One shuffle of both sides together; a sort within keys replaces the inequality join. Of right rows
    at one time the one with the largest values counts. Null keys and times match nothing.
    """
    tag, keep = "_side", [c for c in left.columns if c not in (by, on)]
    l = left.select(by, on, F.lit(1).alias(tag), F.struct(*keep).alias("_l"), F.lit(None).cast(_struct(right, values)).alias("_r"))
    known = right.where(F.col(by).isNotNull() & F.col(on).isNotNull())
    r = known.select(by, on, F.lit(0).alias(tag), F.lit(None).cast(_struct(left, keep)).alias("_l"), F.struct(*values).alias("_r"))
    w = Window.partitionBy(by).orderBy(on, tag, F.col("_r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col(tag) == 1)
    return out.select(by, on, "_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def _struct(df: DataFrame, cols: list[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{dict(df.dtypes)[c]}" for c in cols) + ">"


def bucketed_range(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows of points and ranges with lo <= point < hi, by an equi-join on buckets of ``width``; long ranges span several buckets."""
    bucket: Column = F.floor(F.col(point) / width).cast("long")
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long"))))
    return points.withColumn("_b", bucket).join(r, "_b").where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_b")
