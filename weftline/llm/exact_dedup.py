"""Exact duplicates by a distributed content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over the leading bytes of the normalised text
(then its hash, so that texts with one long common opening spread too), sorted externally inside
each partition so that equal texts are adjacent, and grouped by full comparison of neighbours (the
window over the whole text, which reuses the range partitioning). Texts with very many copies are
found beforehand by a pre-aggregated count and salted over several ranges; their partial groups,
a few rows each, are then merged by another full comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, partitions

#: Characters of the text in the splitters, so that the driver's sample stays small.
PREFIX = 32


def normalise(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and ``row``.

    Of equal normalised texts the row with the largest doc_id is kept (null ids come last; of
    repeated rows with that id exactly one; ties go to any of them, for they are the same but for other
    columns). group_size counts rows. ``row`` is a struct of the columns in ``carry`` (absent when None), so
    that clashing names do no harm. Null and empty texts are one text. Very long texts are compared whole;
    only their first PREFIX characters go into the splitters. An empty table gives an empty table.
    """
    n = partitions(docs.sparkSession)
    cols = [F.col(id_col).cast("long").alias("doc_id"), normalise(F.col(text_col)).alias("norm")]
    if carry is not None:
        cols.append(F.struct(*[F.col(c) for c in carry]).alias("row"))
    keyed = docs.select(*cols).withColumn("h", F.xxhash64("norm"))
    # hot texts: more rows than an eighth of a mean partition; there can be at most 8 n of them, so the broadcast is bounded
    counts = docs.select(F.xxhash64(normalise(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    counts = materialize(counts.where("c > 8"), "copies")
    total = counts.agg(F.sum("c")).first()[0] or 0
    limit = max(16, total // (8 * n))
    hot = counts.where(F.col("c") > limit).select("h", F.ceil(F.col("c") / limit).cast("int").alias("k"))
    salted = keyed.join(F.broadcast(hot), "h", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("k")), F.lit(0)).cast("int")
    )
    salted = salted.withColumn("lead", F.substring("norm", 1, PREFIX))
    ranged = salted.repartitionByRange(n, "lead", "h", "salt")
    same = Window.partitionBy("lead", "h", "salt", "norm")
    first = same.orderBy(F.col("doc_id").desc_nulls_last())
    local = ranged.select(
        *([] if carry is None else ["row"]),
        "doc_id",
        "k",
        F.row_number().over(first).alias("rn"),
        F.first("doc_id").over(first).alias("keep_id"),
        F.count("*").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
        "norm",
        "salt",
    )
    local = local.select(
        *([] if carry is None else ["row"]),
        "doc_id",
        "k",
        "rn",
        "salt",
        "keep_id",
        "size",
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        F.when(F.col("k").isNotNull() & (F.col("rn") == 1), F.col("norm")).alias("norm"),
    )
    local = materialize(local, "sorted")
    # the partial groups of hot texts: at most k rows a text, merged by the whole text
    w = Window.partitionBy("norm").orderBy(F.col("keep_id").desc_nulls_last(), "salt")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = local.where("norm IS NOT NULL").select(
        F.col("text_sha256").alias("m_sha"),
        F.col("salt").alias("m_salt"),
        F.first("keep_id").over(whole).alias("m_keep"),
        F.sum("size").over(whole).alias("m_size"),
        (F.row_number().over(w) == 1).alias("m_first"),
    )
    out = local.join(F.broadcast(merged), (F.col("text_sha256") == F.col("m_sha")) & (F.col("salt") == F.col("m_salt")) & F.col("k").isNotNull(), "left")
    return out.select(
        "doc_id",
        F.when(F.col("m_sha").isNotNull(), F.col("m_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("m_size", "size").cast("long").alias("group_size"),
        ((F.col("rn") == 1) & F.coalesce("m_first", F.lit(True))).alias("kept"),
        "text_sha256",
        *([] if carry is None else ["row"]),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept row of each group of equal texts; same columns as ``docs``. Cases are those of content_groups()."""
    kept = content_groups(docs, id_col, text_col, carry=docs.columns).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
