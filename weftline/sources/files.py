"""Files as tables: type detection, CSV, JSON and XML readers, feeds, sitemaps and OpenAPI documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonempty

# Extension or content type -> kind; first match wins.
KINDS = (("pdf", r"(?i)\.pdf($|\?)|application/pdf"), ("csv", r"(?i)\.csv($|\?)|text/csv"), ("excel", r"(?i)\.xlsx?($|\?)|spreadsheet|ms-excel"), ("json", r"(?i)\.json($|\?)|application/json"), ("xml", r"(?i)\.(xml|rss|atom)($|\?)|/xml|\+xml"))
# Paths at which feeds are looked for, in order.
FEED_PATHS = ("/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/feeds/posts/default", "/index.xml")


def kind(url: Column, content_type: Column, head: Column | None = None) -> Column:
    """File kind by extension, content type or leading bytes; null if none is known."""
    text = F.concat_ws(" ", url, content_type)
    out = F.when(F.startswith(head, F.lit("%PDF")), "pdf") if head is not None else F.when(F.lit(False), "")
    for name, pattern in KINDS:
        out = out.when(F.rlike(text, F.lit(pattern)), name)
    return out


def html_content_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))).isin("text/html", "application/xhtml+xml", "")


def read_csv(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """At most ``rows`` rows (the size of a preview is the feature); types are inferred."""
    return spark.read.csv(path, header=True, inferSchema=True).limit(rows)


def describe(df: DataFrame) -> DataFrame:
    """One row: columns and row_count."""
    return df.agg(F.count("*").alias("row_count")).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.option("rowTag", row_tag).xml(path)


def sitemap_urls(xml: Column, most: int = 500) -> Column:
    """<loc> texts of a sitemap document."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.slice(found, 1, most)


def feed_items(xml: Column, most: int = 50) -> Column:
    """array<struct<title, link>> of RSS items or Atom entries."""
    text = F.coalesce(xml, F.lit(""))
    items = F.regexp_extract_all(text, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    plain = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"<!\[CDATA\[|\]\]>", ""), r"\s+", " "))

    def item(i: Column) -> Column:
        link = F.coalesce(
            nonempty(plain(F.regexp_extract(i, r"(?is)<link>(.*?)</link>", 1))),
            nonempty(F.regexp_extract(i, r"""(?is)<link[^>]*\bhref=["']([^"']+)["']""", 1)),
            nonempty(plain(F.regexp_extract(i, r"(?is)<guid[^>]*>(.*?)</guid>", 1))),
        )
        return F.struct(plain(F.regexp_extract(i, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), link.alias("link"))

    return F.slice(F.transform(items, item), 1, most)


def feed_candidates(origin: Column) -> Column:
    return F.transform(F.array(*[F.lit(p) for p in FEED_PATHS]), lambda p: F.concat(origin, p))


def openapi_endpoints(specs: DataFrame, spec_col: str = "spec") -> DataFrame:
    """Other columns of ``specs`` with one row for each path and method of its OpenAPI documents; malformed documents give none."""
    methods = F.array(*[F.lit(m) for m in ("get", "post", "put", "patch", "delete", "head", "options")])
    keep = [c for c in specs.columns if c != spec_col]
    parsed = F.from_json(spec_col, "struct<paths:map<string,map<string,string>>,basePath:string,servers:array<struct<url:string>>>")
    rows = specs.select(*keep, parsed.alias("s")).select(*keep, F.col("s.basePath").alias("base"), F.explode("s.paths").alias("path", "ops"))
    rows = rows.select(*keep, "base", "path", F.explode(F.map_keys("ops")).alias("method")).where(F.array_contains(methods, F.lower("method")))
    return rows.select(*keep, F.concat(F.coalesce("base", F.lit("")), "path").alias("path"), F.upper("method").alias("method"))
