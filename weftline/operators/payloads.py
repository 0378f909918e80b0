"""Observed JSON payloads as variants: malformed ones apart, their paths and types, frequent paths as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of nesting that ``paths`` goes down.
DEPTH = 5


def parse(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``payload`` (variant, null where it can't be parsed) and ``malformed``; a null text is neither."""
    v = F.try_parse_json(column)
    return rows.withColumn("payload", v).withColumn("malformed", F.col(column).isNotNull() & F.col("payload").isNull())


def kind(v) -> F.Column:
    """OBJECT, ARRAY, or a scalar's type."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def paths(parsed: DataFrame) -> DataFrame:
    """(path, type, n): how often each path holds a value of each type. Elements of arrays share the path ``[*]``.

    One projection a level: values are taken apart by variant_explode, and each level is counted by partial
    aggregates, so nothing larger than the values themselves travels. Levels below DEPTH count as their object or array.
    """
    spark = parsed.sparkSession
    level = parsed.where("payload IS NOT NULL").select(F.lit("$").alias("path"), F.col("payload").alias("v"))
    counted = None
    for depth in range(DEPTH + 1):
        typed = level.select("path", "v", kind("v").alias("type"))
        now = typed.groupBy("path", "type").agg(F.count("*").alias("n"))
        counted = now if counted is None else counted.unionByName(now)
        if depth < DEPTH:
            nested = typed.where("type IN ('OBJECT', 'ARRAY')")
            each = spark.sql("SELECT path, e.key, e.value AS v FROM {nested}, LATERAL variant_explode(v) AS e", nested=nested)
            level = each.select(F.concat("path", F.when(F.col("key").isNull(), "[*]").otherwise(F.concat(F.lit("."), "key"))).alias("path"), "v")
    return counted


def shred(parsed: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``columns``: name -> (path, type). Each becomes a column, null where the path is absent or of another type."""
    return parsed.withColumns({name: F.try_variant_get("payload", path, type_) for name, (path, type_) in columns.items()})


def frequent(counted: DataFrame, least: int) -> list[tuple[str, str]]:
    """(path, type) of scalars outside arrays that occur ``least`` times or more: what is worth a column of its own. Bounded by distinct paths."""
    rows = counted.where((F.col("n") >= least) & ~F.contains("path", F.lit("[*]")) & ~F.col("type").isin("OBJECT", "ARRAY", "VOID"))
    return [(r["path"], r["type"]) for r in rows.orderBy("path", "type").collect()]


def schema(parsed: DataFrame) -> DataFrame:
    """One row: the schema that all payloads together have."""
    return parsed.agg(F.schema_of_variant_agg("payload").alias("schema"))
