"""Registered queries: name -> (function of (spark, sf_dir), SQL for the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL text
def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def has(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {q(pattern)}), false)"


def extract(col: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({col}, {q(pattern)}, {group})"


def clean(col: str) -> str:
    return f"trim(regexp_replace(coalesce({col}, ''), '\\s+', ' ', 'g'))"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def words(items) -> str:
    return "[" + ", ".join(q(w) for w in items) + "]"
