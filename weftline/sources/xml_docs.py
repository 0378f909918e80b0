"""Feeds and sitemaps by Spark's XML parser: namespaces, CDATA, entities, indexes; malformed documents apart.

A document in a column is parsed by from_xml with the schema of all kinds at once, so one pass tells RSS, RDF, Atom,
sitemaps and sitemap indexes apart. Files that hold one large document are read by row tag, which splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "ignoreSurroundingSpaces": "true"}
_TEXT = "struct<_VALUE: string>"
_LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
_RSS = f"struct<title: string, link: {_LINK}, guid: {_TEXT}, description: string, pubDate: string>"
_ATOM = f"struct<title: {_TEXT}, link: {_LINK}, id: string, summary: {_TEXT}, updated: string>"
_PLACE = "struct<loc: string, lastmod: string, priority: double>"
#: Children of the root of every kind of document that is known here.
DOCUMENT = f"channel struct<title: string, item: array<{_RSS}>>, item array<{_RSS}>, title {_TEXT}, entry array<{_ATOM}>, url array<{_PLACE}>, sitemap array<{_PLACE}>, corrupt string"


def parse(docs: DataFrame, xml: str) -> DataFrame:
    """``docs`` with ``doc`` (the parsed document, null if malformed), ``kind`` and ``malformed`` (the text of documents that can't be parsed).

    kind is rss, rdf, atom, sitemap, sitemap_index or other; null for malformed, empty and null texts.
    """
    text = F.trim(F.coalesce(F.col(xml), F.lit("")))
    body = F.when(text != "", text)
    d = docs.withColumn("_d", F.from_xml(body, DOCUMENT, _OPTIONS))
    bad = body.isNotNull() & (F.col("_d").isNull() | F.col("_d.corrupt").isNotNull())
    d = d.withColumn("malformed", F.when(bad, F.col(xml))).withColumn("doc", F.when(~bad & body.isNotNull(), F.col("_d")))
    kind = F.when(F.col("doc.channel.item").isNotNull() | (F.col("doc.channel").isNotNull() & F.col("doc.item").isNull()), "rss").when(F.col("doc.item").isNotNull(), "rdf").when(F.col("doc.entry").isNotNull(), "atom").when(F.col("doc.url").isNotNull(), "sitemap").when(F.col("doc.sitemap").isNotNull(), "sitemap_index").when(F.col("doc").isNotNull(), "other")
    return d.withColumn("kind", kind).drop("_d")


def _squeezed(c: Column) -> Column:
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(s != "", s)


def items(parsed: DataFrame, most: int = 50) -> DataFrame:
    """The other columns with one row for each of a feed's first ``most`` items: (pos, title, link, summary, published)."""
    rss = lambda i: F.struct(
        _squeezed(i["title"]).alias("title"),
        F.coalesce(_squeezed(F.get(F.filter(i["link"], lambda x: _squeezed(x["_VALUE"]).isNotNull()), F.lit(0))["_VALUE"]), _squeezed(F.get(i["link"], F.lit(0))["_href"]), _squeezed(i["guid"]["_VALUE"])).alias("link"),
        _squeezed(i["description"]).alias("summary"),
        i["pubDate"].alias("published"),
    )
    main = lambda links: F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    atom = lambda i: F.struct(_squeezed(i["title"]["_VALUE"]).alias("title"), F.coalesce(main(i["link"]), F.get(i["link"], F.lit(0))["_href"], i["id"]).alias("link"), _squeezed(i["summary"]["_VALUE"]).alias("summary"), i["updated"].alias("published"))
    found = F.coalesce(F.transform("doc.channel.item", rss), F.transform("doc.item", rss), F.transform("doc.entry", atom))
    rest = [c for c in parsed.columns if c not in ("doc", "malformed")]
    rows = parsed.where("kind IN ('rss', 'rdf', 'atom')").select(*rest, F.posexplode(F.slice(found, 1, most)).alias("pos", "i"))
    return rows.select(*rest, "pos", "i.*")


def places(parsed: DataFrame, most: int = 500) -> DataFrame:
    """The other columns with one row for each of a sitemap's first ``most`` locations: (loc, lastmod, priority, nested); nested ones are sitemaps themselves."""
    found = F.coalesce("doc.url", "doc.sitemap")
    rest = [c for c in parsed.columns if c not in ("doc", "malformed")]
    rows = parsed.where("kind IN ('sitemap', 'sitemap_index')").select(*rest, F.inline(F.slice(found, 1, most)))
    return rows.withColumn("loc", F.trim("loc")).where("loc <> ''").withColumn("nested", F.col("kind") == "sitemap_index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): every file below ``path`` as one document, whole."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of large documents by ``row_tag``; files are split. With a column ``corrupt`` in ``schema``, malformed rows are kept in it."""
    return spark.read.schema(schema).options(**_OPTIONS).option("rowTag", row_tag).xml(path)
