"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key -ln(u) / q with u a hash of its id and q its quality weight;
in key order a source's documents are a weighted sample without replacement. A source whose budget
exceeds its size gets complete epochs first; the rest of the budget is filled by the documents whose
prefix sum of sizes, in key order, stays nearest to it.

The prefix sums are two-level: Spark's sampled splitters cut the rows, in the order of source and key, into
ranges of like size whatever the keys' distribution; each range is summed in order by itself and the ranges'
totals are accumulated per source. So no task holds a whole source, and a hot source spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, drop_scratch, materialize, partitions, scratch_tables

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
LEAST_QUALITY = 1e-6
#: A source's rows in the order in which they are taken.
ORDER = ("key", "doc_id", "place")
_BLANKS = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks; null: 0. Counted as the length of the text with one letter a word, for
    ``regexp_count`` makes an array of all words, which takes many times a very long text's memory."""
    marks = F.translate(F.regexp_replace(text, F.lit(_WORD), F.lit("x")), _BLANKS, "")
    return F.coalesce(F.octet_length(marks), F.lit(0)).cast("long")


def uniform(id_: Column, text: Column | None = None) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of the id, or where it is null of the text; the same in every run."""
    return (F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), *([] if text is None else [text]), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality_weight(n_chars: Column, words: Column) -> Column:
    """Default quality weight: 1 for texts of 50 words and more with common word lengths, less otherwise."""
    mean = F.when(words > 0, n_chars / words).otherwise(0.0)
    shape = F.when((mean >= 4.0) & (mean <= 10.0), 1.0).otherwise(0.5)
    return shape * F.greatest(F.lit(0.2), F.least(F.lit(1.0), words / 50.0))


def source_targets(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from stats(source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total size. No
    target exceeds ``max_epochs`` times its source; what is above is shared again by weight among
    the others until none is above. In closed form: with sources in the order of their cap per unit
    of weight, the first ones are capped and the others get weight times one common level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = stats.withColumn("w", cycle).withColumn("cap", F.col("source_size") * float(max_epochs))
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "source_size", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    open_ = F.col("level") * F.col("w") <= F.col("cap")
    s = s.withColumn("rank", F.row_number().over(by_cap)).withColumn("open", open_)
    s = s.withColumn("common", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("common"), F.lit(0.0)) * F.col("w")).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, carry: bool) -> DataFrame:
    """Every row's source, doc_id, size, key and place, and with ``carry`` the row itself; written, so that a costly quality is computed once.

    ``place`` numbers the rows as they are read, so that rows of one key and id have an order.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(
        *row,
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).alias("n"),
        uniform(F.col(id_col), F.col(text_col)).alias("u"),
        F.monotonically_increasing_id().alias("place"),
        *([] if quality is None else [quality.cast("double").alias("q")]),
    )
    q = quality_weight(F.col("n"), F.col("size")) if quality is None else F.greatest(F.coalesce(F.nanvl("q", F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_QUALITY))
    key = (-F.log("u") / q).alias("key")
    return materialize(base.select(*(["row"] if carry else []), "doc_id", "source", "size", key, "place"), "sizes", TEXT_ROWS)


def ranges(rows: DataFrame) -> DataFrame:
    """rows(source, key, doc_id, place, ...) with ``part``, the number of a row's range in that order."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "source", *[c for c in ORDER if c in rows.columns])
    return materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")


def mix_plan(base: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut) for base(doc_id, source, size, key, place).

    ``cut`` is the last (key, doc_id, place) of the fractional selection, null if it is empty.
    """
    since = scratch_tables()
    plan = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialize(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    part = plan.where("rest > 0").select(F.col("source").alias("s"), "rest")
    rows = ranges(base.select("source", *ORDER, "size").join(part, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "part").orderBy(*ORDER)
    prefix = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    prefix = prefix.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    chosen = prefix.where(F.col("ahead") + F.col("inside") - F.col("size") / 2.0 <= F.col("rest"))
    cuts = chosen.groupBy("source").agg(F.max(F.struct(*ORDER)).alias("cut")).select(F.col("source").alias("s"), "cut")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut")
    plan = materialize(plan, "cuts")
    drop_scratch(since, plan)
    return plan


def _copies() -> Column:
    return F.col("epochs") + F.coalesce(F.struct(*ORDER) <= F.col("cut"), F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0; very long texts are counted whole), ``copies`` is how often the mix
    takes the document whole and taken = copies * size. ``quality`` scales a document's chance (null, NaN and
    less count as LEAST_QUALITY). A source's taken words miss its target by at most half the size of its last
    document taken. Null sources are one source, the last in order. Documents without words take part with size 0.
    Null ids draw their key by the text. Ties of keys go by doc_id, null first, then by the rows' places in the
    table as it is read; so repeated rows and ids have one key, but are taken row by row. Other columns don't matter, whatever their names. Reruns agree. An empty table gives an empty table.
    """
    base = _keyed(docs, id_col, text_col, source_col, quality, carry=False)
    p = mix_plan(base).withColumnRenamed("source", "s")
    out = base.join(p, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as mix() takes it; same columns. Cases are those of mix()."""
    keyed = _keyed(docs, id_col, text_col, source_col, quality, carry=True)
    p = mix_plan(keyed.drop("row")).withColumnRenamed("source", "s")
    taken = keyed.join(p, F.col("source").eqNullSafe(F.col("s"))).select("row", _copies().alias("copies")).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
