"""Queries on sources and report sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api, session
from ..operators import findings
from ..sources import delimited, documents, files, sinks, xml_docs
from . import pipeline
from . import queries_pages as qp
from . import queries_records as qr
from .registry import q, query, table

_SITEMAP = """'<urlset><url><loc>' || url || '</loc></url><url><loc> http://s.example.com/' || page_id || ' </loc></url></urlset>'"""
_LOC = r"(?is)<loc>\s*([^<\s]+)\s*</loc>"


@query(f"SELECT page_id, unnest(regexp_extract_all({_SITEMAP}, {q(_LOC)}, 1)) AS loc FROM pages")
def sitemap_urls(spark, d):
    return qp.pages(spark, d).select("page_id", F.explode(files.sitemap_urls(F.expr(_SITEMAP))).alias("loc"))


_FEED = """'<rss><channel><item><title>T' || page_id || '</title><link>' || replace(url, '&', '&amp;') || '</link></item><item><title><![CDATA[ B  c ]]></title><guid>g' || page_id || '</guid></item></channel></rss>'"""


@query("SELECT page_id, 'T' || page_id AS title, replace(url, '&', '&amp;') AS link FROM pages UNION ALL SELECT page_id, 'B c', 'g' || page_id FROM pages")
def feed_items(spark, d):
    return qp.pages(spark, d).select("page_id", F.inline(files.feed_items(F.expr(_FEED))))


# a feed a page: RSS with CDATA and entities, Atom with a namespace; every ninth is cut off
_MIXED = """CASE page_id % 3 WHEN 0 THEN '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">T' || page_id || '</title><link rel="self" href="http://s"/><link href="' || replace(url, '&', '&amp;') || '"/><id>i</id></entry></feed>' ELSE '<?xml version="1.0"?><rss><channel><title>C</title><item><title>A &amp;amp; ' || page_id || '</title><link>' || replace(url, '&', '&amp;') || '</link></item><item><title><![CDATA[ B <i>c</i> ]]></title><guid isPermaLink="false">g' || page_id || '</guid></item></channel></rss>' END"""
_FEEDS = f"CASE WHEN page_id % 9 = 4 THEN left({_MIXED}, 60) ELSE {_MIXED} END"


@query(
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'atom' ELSE 'rss' END AS kind, 0 AS pos, CASE page_id % 3 WHEN 0 THEN 'T' || page_id ELSE 'A &amp; ' || page_id END AS title, url AS link FROM pages WHERE page_id % 9 <> 4 UNION ALL SELECT page_id, 'rss', 1, 'B <i>c</i>', 'g' || page_id FROM pages WHERE page_id % 9 <> 4 AND page_id % 3 <> 0"
)
def feed_entries(spark, d):
    """Items of feeds by the XML parser, entities decoded."""
    p = xml_docs.parse(qp.pages(spark, d).select("page_id", F.expr(_FEEDS).alias("xml")), "xml")
    return xml_docs.items(p).select("page_id", "kind", "pos", "title", "link")


@query("SELECT page_id, 60::BIGINT AS n FROM pages WHERE page_id % 9 = 4")
def feed_malformed(spark, d):
    """Feeds that can't be parsed, apart from the others."""
    p = xml_docs.parse(qp.pages(spark, d).select("page_id", F.expr(_FEEDS).alias("xml")), "xml")
    return p.where("malformed IS NOT NULL").select("page_id", F.char_length("malformed").cast("long").alias("n"))


@query("SELECT page_id, url AS loc, false AS nested FROM pages UNION ALL SELECT DISTINCT -1 - page_id // 50, 'http://s.example.com/' || (page_id // 50) || '.xml', true FROM pages")
def sitemap_files(spark, d):
    """Sitemaps and their indexes, read as files: fifty pages a file."""
    place = F.concat(F.lit("<url><loc> "), sinks.xml_escape(F.col("url")), F.lit(" </loc><lastmod>"), "page_id", F.lit("</lastmod></url>"))
    part = F.floor(F.col("page_id") / 50).alias("part")
    maps = qp.pages(spark, d).groupBy(part).agg(F.collect_list(place).alias("p"))  # fifty at most
    maps = maps.select("part", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join("p", "\n"), F.lit("</urlset>")).alias("xml"))
    index = maps.select((-1 - F.col("part")).alias("part"), F.concat(F.lit("<sitemapindex><sitemap><loc>http://s.example.com/"), "part", F.lit(".xml</loc><lastmod>"), -1 - F.col("part"), F.lit("</lastmod></sitemap></sitemapindex>")).alias("xml"))
    path = session.scratch(spark, "sitemaps")
    maps.unionByName(index).repartition("part").write.partitionBy("part").text(path)
    found = xml_docs.places(xml_docs.parse(xml_docs.read_documents(spark, path).select("xml"), "xml"))
    return found.select(F.col("lastmod").cast("long").alias("page_id"), "loc", "nested")


# events as dirty files: two layouts, some lines short, some with a bad number
_DIRTY = "CASE WHEN event_id % 13 = 4 THEN 'short' WHEN event_id % 17 = 3 THEN 'number' ELSE 'good' END"


@query(f"SELECT event_id % 2 AS layout, count(*) AS rows, count(*) FILTER ({_DIRTY} = 'good') AS good, count(*) FILTER ({_DIRTY} <> 'good') AS malformed, round(sum(CASE WHEN {_DIRTY} = 'good' THEN value ELSE 0 END), 4) AS total FROM events GROUP BY ALL")
def dirty_csv(spark, d):
    """CSV files of two layouts and encodings, written from the events with bad lines among them: every line is accounted for."""
    e = table(spark, d, "events").withColumn("dirt", F.expr(_DIRTY))
    value = F.when(F.col("dirt") == "number", "n/a").otherwise(F.col("value").cast("string"))
    path = session.scratch(spark, "csv")
    layouts = (
        (0, ",", ("event_id", "kind", "value"), lambda r: F.when(F.col("dirt") == "short", F.concat_ws(",", "event_id", "event_type")).otherwise(F.concat_ws(",", "event_id", "event_type", value)), "UTF-8"),
        (1, ";", ("value", "extra", "event_id", "kind"), lambda r: F.when(F.col("dirt") == "short", value).otherwise(F.concat_ws(";", value, F.lit("\u00e9t\u00e9"), "event_id", "event_type")), "ISO-8859-1"),
    )
    for layout, sep, names, line, encoding in layouts:
        rows = e.where(F.col("event_id") % 2 == layout).select(line(None).alias(sep.join(names)))
        rows.write.option("header", True).option("quote", "").option("sep", "\u0001").option("encoding", encoding).csv(f"{path}/{layout}")
    got = delimited.read_csv(spark, path, "event_id long, kind string, value double")
    got = got.withColumn("layout", F.coalesce(F.col("event_id") % 2, F.lit(1)).cast("long"))  # short lines of the second layout hold the value alone
    s = delimited.account(got, "layout").join(got.where("malformed IS NULL").groupBy("layout").agg(F.round(F.sum("value"), 4).alias("total")), "layout")
    return s.select("layout", "rows", "good", "malformed", "total")


@query("SELECT event_id % 3 AS part, count(*) AS rows, count(*) FILTER (event_id % 19 <> 7) AS good, count(*) FILTER (event_id % 19 = 7) AS malformed FROM events GROUP BY ALL")
def dirty_json(spark, d):
    """JSON lines of differing fields, some cut off; the schema is that of all files together."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("part"), F.to_json(F.struct("event_id", F.when(F.col("event_id") % 3 == 1, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 == 2, F.col("event_type")).alias("kind"))).alias("line"))
    path = session.scratch(spark, "json")
    e.select("part", F.when(F.col("event_id") % 19 == 7, F.left("line", F.lit(9))).otherwise(F.col("line")).alias("line")).repartition("part").write.partitionBy("part").text(path)
    got = delimited.read_json(spark, path, glob="*.txt")
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part")
    return delimited.account(got.select("*", part), "part")


@query(f"WITH {qp._EDGES} SELECT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL")
def graph_documents(spark, d):
    """The link graph written as GraphML documents and read back by row tag."""
    path = session.scratch(spark, "graphml")
    documents.write(documents.dealt(qp.site_edges(qp.pages(spark, d)).where("src IS NOT NULL AND dst IS NOT NULL")), path, "graphml")
    edges = xml_docs.read_rows(spark, path, "edge", "_source string, _target string")
    return edges.select(F.coalesce("_source", F.lit("")).alias("src"), F.coalesce("_target", F.lit("")).alias("dst"))


@query("SELECT event_id, 'http://h.example.com/' || event_type AS url, length(props) AS size FROM events")
def har_documents(spark, d):
    """Exchanges written as HAR documents and read back as JSON."""
    path = session.scratch(spark, "har")
    e = table(spark, d, "events")
    entry = sinks.har_entry(F.concat(F.lit("http://h.example.com/"), F.col("event_type")), F.lit(200), F.lit("application/json"), F.col("ts").cast("timestamp"), F.col("event_id"), F.col("props"))
    documents.write(documents.dealt(e.select(entry.alias("entry"))), path, "har")
    log = spark.read.schema("log struct<entries: array<struct<time: long, request: struct<url: string>, response: struct<content: struct<size: long>>>>>").option("multiLine", True).json(path)
    return log.select(F.explode("log.entries").alias("e")).select(F.col("e.time").alias("event_id"), F.col("e.request.url").alias("url"), F.col("e.response.content.size").alias("size"))


_PATHS = ", ".join(f"'{p}'" for p in files.FEED_PATHS)


@query(f"SELECT DISTINCT 'http://' || {qp.s_host('url')} || unnest([{_PATHS}]) AS candidate FROM pages")
def feed_candidates(spark, d):
    from ..functions import urls

    return qp.pages(spark, d).select(F.explode(files.feed_candidates(F.concat(F.lit("http://"), urls.host(F.col("url"))))).alias("candidate")).distinct()


_TYPED = "CASE page_id % 5 WHEN 0 THEN 'http://f/a.pdf' WHEN 1 THEN 'http://f/data.csv?x=1' WHEN 2 THEN 'http://f/b' ELSE 'http://f/c.rss' END"
_CTYPE = "CASE page_id % 5 WHEN 2 THEN 'application/json; charset=utf-8' ELSE 'text/html' END"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(u || ' ' || c, {q(p)}) THEN '{n}'" for n, p in files.KINDS) + " END"


@query(f"WITH m AS (SELECT page_id, {_TYPED} AS u, {_CTYPE} AS c FROM pages) SELECT page_id, {_KIND} AS kind, lower(trim(split_part(c, ';', 1))) IN ('text/html', 'application/xhtml+xml', '') AS is_html FROM m")
def file_kind(spark, d):
    m = qp.pages(spark, d).select("page_id", F.expr(_TYPED).alias("u"), F.expr(_CTYPE).alias("c"))
    return m.select("page_id", files.kind(F.col("u"), F.col("c")).alias("kind"), files.html_content_type(F.col("c")).alias("is_html"))


_SPEC = """'{"openapi":"3.0.0","basePath":"/b' || (page_id % 3) || '","paths":{"/items/' || page_id || '":{"get":{"summary":"x"},"post":{}},"/health":{"get":{},"x-note":"n"}}}'"""


@query("SELECT page_id, unnest(['/b' || (page_id % 3) || '/items/' || page_id, '/b' || (page_id % 3) || '/items/' || page_id, '/b' || (page_id % 3) || '/health']) AS path, unnest(['GET', 'POST', 'GET']) AS method FROM pages")
def openapi_endpoints(spark, d):
    return files.openapi_endpoints(qp.pages(spark, d).select("page_id", F.expr(_SPEC).alias("spec")))


@query(f"WITH {qp.S_LINKS[1:]} SELECT page_id, 'link' AS type, href AS src_or_href, text AS text_or_alt FROM links UNION ALL SELECT page_id, 'heading', NULL, content FROM (WITH {qp._SEGS} SELECT * FROM segs WHERE field = 'heading')")
def report_long_rows(spark, d):
    """Links and headings in the long form of the CSV report."""
    links = qp.page_link_rows(qp.pages(spark, d)).select("page_id", F.lit("link").alias("type"), F.col("href").alias("src_or_href"), F.col("text").alias("text_or_alt"))
    heads = qp.segment_rows(qp.pages(spark, d)).where("field = 'heading'").select("page_id", F.lit("heading").alias("type"), F.lit(None).cast("string").alias("src_or_href"), F.col("content").alias("text_or_alt"))
    return links.unionByName(heads)


@query(
    f"""WITH {qp._EDGES}, n AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges)
SELECT 1 AS ord, '<node id="' || replace(replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"/>' AS line FROM n
UNION ALL SELECT 2, '<edge source="' || replace(src, '&', '&amp;') || '" target="' || replace(replace(replace(replace(dst, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"/>' FROM edges"""
)
def crawl_graph(spark, d):
    return sinks.graphml_lines(qp.site_edges(qp.pages(spark, d))).where("ord IN (1, 2)")


# ---------------------------------------------------------------- reports written and read back
_DECIDED = f"WITH {qr._VOTE} SELECT url, field, winner, agreement, agreement < 1 AS conflict FROM vote"


@query(_DECIDED)
def audit_json(spark, d):
    """Decisions written as JSON by conflict and read back."""
    path = session.scratch(spark, "audit-json")
    sinks.write_audit(qr.vote_exact(spark, d).withColumn("conflict", F.col("agreement") < 1), path)
    return spark.read.schema("url string, field string, winner string, agreement double, conflict boolean").json(path).select("url", "field", "winner", "agreement", "conflict")


@query("SELECT url, 'engine' || (page_id % 3) AS engine_id, left(html, 1000) AS raw_html FROM pages")
def raw_records(spark, d):
    """Raw pages by engine, cut to previews, written and read back."""
    path = session.scratch(spark, "raw")
    sinks.write_raw(qp.pages(spark, d).select("url", F.concat(F.lit("engine"), F.col("page_id") % 3).alias("engine_id"), F.col("html").alias("raw_html")), path)
    return spark.read.schema("url string, raw_html string, engine_id string").json(path).select("url", "engine_id", "raw_html")


_SECRETS = f"WITH f AS ({findings.oracle_sql('documents', 'doc_id', 'text')})"


@query(f"{_SECRETS} SELECT severity, pattern_name, match_preview, 'document' AS source_type, doc_id::VARCHAR AS source_url FROM f")
def secrets_csv(spark, d):
    """Findings exported as quoted CSV and read back, line breaks and quotes kept."""
    path = session.scratch(spark, "secrets")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    sinks.write_secrets_csv(findings.located(docs, "document", "id", "text"), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return back.select("severity", "pattern_name", "match_preview", "source_type", "source_url").distinct()


@query(f"{_SECRETS} SELECT doc_id, pattern_name, match_preview FROM f WHERE severity = 'high' AND doc_id = (SELECT min(doc_id) FROM f WHERE severity = 'high')")
def findings_filtered(spark, d):
    """Findings of one severity on one page."""
    found = findings.scan(table(spark, d, "documents"), "doc_id", "text").withColumn("source_url", F.col("doc_id").cast("string"))
    first = found.where("severity = 'high'").agg(F.min("doc_id").alias("i")).first()["i"]
    return api.filter_findings(found, "high", str(first)).select("doc_id", "pattern_name", "match_preview")


@query(f"WITH {qr._ER} SELECT url, title, len(links)::BIGINT AS links FROM er WHERE engine_id = 'static_requests'")
def report_json(spark, d):
    """Documents written as JSON lines and read back."""
    path = session.scratch(spark, "report-json")
    sinks.write_json(qr.records(spark, d).where("engine_id = 'static_requests'").select("url", "title", "links"), path)
    return spark.read.schema("url string, title string, links array<string>").json(path).select("url", "title", F.size("links").cast("long").alias("links"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def report_expiry(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    newest = e.agg(F.max("ts").alias("now"))
    return sinks.expired(e.join(F.broadcast(newest)), "ts", F.col("now"), 24).select("event_id")


@query()
def har_log(spark, d):
    e = table(spark, d, "events")
    entry = sinks.har_entry(F.concat(F.lit("http://h.example.com/"), F.col("event_type")), F.lit(200), F.lit("application/json"), F.col("ts").cast("timestamp"), F.col("value"), F.col("props"))
    return e.select("event_id", entry.alias("entry"))


@query()
def html_report(spark, d):
    return sinks.html_reports(pipeline.merge(pipeline.engine_results(qp.pages(spark, d))))
