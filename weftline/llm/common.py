"""Helpers shared by the corpus operators: table access, shared scratch tables, hot-key sizes."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Rows of whole texts in a batch.
TEXT_ROWS = 1000
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Within this block Python workers get at most ``rows`` rows at a time; None: as many as usual."""
    usual = spark.conf.get(_BATCH)
    try:
        if rows is not None:
            spark.conf.set(_BATCH, str(rows))
        yield
    finally:
        spark.conf.set(_BATCH, usual)


def materialize(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared folder and read it back.

    The written table outlives lost executors, unlike cached blocks or a local checkpoint. ``batch_rows``: most
    rows that Python workers get at a time in this write; for whole texts, of which the usual batch is large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    with batches_of(spark, batch_rows):
        df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def drop_scratch(since: int = 0, *keep: DataFrame) -> None:
    """Delete the scratch tables that this process has written, from the ``since``-th on, but for materialized ``keep``.

    For tables whose readers are written themselves; the rest goes when the process ends.
    """
    kept = {df._weft_path for df in keep}
    gone = [w for w in _written[since:] if w[1] not in kept]
    _written[since:] = [w for w in _written[since:] if w[1] in kept]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may already have ended
            pass


def scratch_tables() -> int:
    """How many scratch tables there are now."""
    return len(_written)


atexit.register(drop_scratch)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII rows take the fast built-in, others a character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row (the optimizer would inline it at each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)
