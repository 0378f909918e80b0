"""Version history: numbering, latest state, change and redesign detection, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def with_versions(snapshots: DataFrame, key: str, *order: str) -> DataFrame:
    return snapshots.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def latest(history: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by a partial aggregate rather than a sort."""
    rest = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def tracked(history: DataFrame, key: str, version: str) -> DataFrame:
    return history.groupBy(key).agg(F.max(version).alias("latest_version"), F.count("*").alias("versions"))


def changes(history: DataFrame, key: str, version: str) -> DataFrame:
    """history(key, version, content_hash, headings, ...) with changed, previous_hash and diff_summary against the version before."""
    w = Window.partitionBy(key).orderBy(version)
    before, count = F.lag("content_hash").over(w), F.lag("headings").over(w)
    h = history.withColumn("before", before).withColumn("delta", F.col("headings") - F.coalesce(count, F.lit(0)))
    changed = F.col("before").isNull() | (F.col("before") != F.col("content_hash"))
    summary = (
        F.when(F.col("before").isNull(), "first_crawl")
        .when(~changed, "no change")
        .when(F.col("delta") > 0, F.concat(F.lit("+"), F.col("delta").cast("string"), F.lit(" headings")))
        .when(F.col("delta") < 0, F.concat(F.col("delta").cast("string"), F.lit(" headings")))
        .otherwise("content updated")
    )
    return h.withColumn("changed", changed).withColumn("previous_hash", F.when(changed, F.col("before"))).withColumn("diff_summary", summary).drop("before", "delta")


def redesigned(h1, h2, l1, l2, hash1, hash2):
    """Content changed and headings or links changed by more than 40 percent."""
    ratio = lambda a, b: F.abs(F.greatest(a, F.lit(1)) - F.greatest(b, F.lit(1))) / F.greatest(a, F.lit(1))
    return (hash1 != hash2) & ((ratio(h1, h2) > C.REDESIGN_RATIO) | (ratio(l1, l2) > C.REDESIGN_RATIO))


def version_pairs(history: DataFrame, key: str, version: str) -> DataFrame:
    """Each version joined with the one before it: columns a_* and b_*."""
    a = history.select(key, (F.col(version) + 1).alias(version), *[F.col(c).alias(f"a_{c}") for c in history.columns if c not in (key, version)])
    b = history.select(key, version, *[F.col(c).alias(f"b_{c}") for c in history.columns if c not in (key, version)])
    return a.join(b, [key, version])


def text_diff(a, b):
    """Unified difference of two texts by line, two lines of context, 5000 characters at most."""

    def run(x: str, y: str) -> str:
        from difflib import unified_diff

        return "\n".join(unified_diff((x or "").splitlines(), (y or "").splitlines(), lineterm="", n=2))[:5000]

    return F.udf(run, "string", useArrow=True)(a, b)


def page(history: DataFrame, key: str, value, version: str, limit: int, offset: int = 0) -> DataFrame:
    return history.where(F.col(key) == value).orderBy(F.desc(version)).offset(offset).limit(limit)
