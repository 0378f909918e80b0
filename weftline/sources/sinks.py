"""Report sinks: JSON, CSV long form, sheets, GraphML, HAR, HTML, audit, metrics. Tables are written by Spark's writers."""

from __future__ import annotations

import html as _html
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import slices
from . import documents

LINK_KINDS = ("link", "image", "heading")


def write_json(merged: DataFrame, path: str) -> None:
    merged.write.mode("overwrite").json(path)


def long_rows(merged: DataFrame) -> DataFrame:
    """(url, type, src_or_href, text_or_alt, extra) for links, images and headings, from one explode of the document."""
    none = F.lit(None).cast("string")

    def row(kind: str, a: Column, b: Column, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), a.alias("src_or_href"), b.alias("text_or_alt"), c.alias("extra"))

    rows = F.concat(
        F.transform("links", lambda x: row("link", x["href"], x["text"], none)),
        F.transform("images", lambda x: row("image", x["src"], x["alt"], none)),
        F.transform("headings", lambda x: row("heading", none, x["text"], F.concat(F.lit("h"), x["level"].cast("string")))),
    )
    return merged.select("url", F.inline(rows))


def write_csv(merged: DataFrame, path: str) -> None:
    long_rows(merged).write.mode("overwrite").option("header", True).csv(path)


def sheets(merged: DataFrame) -> dict[str, DataFrame]:
    """The four sheets of a workbook as tables."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    links = merged.select("url", host.alias("host"), F.inline("links"))
    return {
        "summary": merged.select("url", "title", "description", "language", "page_type", "confidence_score"),
        "links": links.withColumn("is_external", F.regexp_extract("href", r"^[a-z]+://([^/]+)", 1) != F.col("host")).drop("host"),
        "images": merged.select("url", F.inline("images")),
        "headings": merged.select("url", F.inline("headings")),
    }


def write_sheets(merged: DataFrame, path: str, fmt: str = "parquet") -> None:
    for name, df in sheets(merged).items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def workbook_rows(merged: DataFrame) -> DataFrame:
    """(sheet, ord, cells) of the four sheets, each with its header."""
    parts = []
    for name, df in sheets(merged).items():
        head = df.sparkSession.range(1).select(F.lit(name).alias("sheet"), F.lit(0).alias("ord"), F.array(*[F.lit(c) for c in df.columns]).alias("cells"))
        body = df.select(F.lit(name).alias("sheet"), F.lit(1).alias("ord"), F.array(*[F.col(c).cast("string") for c in df.columns]).alias("cells"))
        parts += [head, body]
    return reduce(DataFrame.unionByName, parts)


def write_workbook(merged: DataFrame, path: str) -> None:
    """One workbook of all documents. It is one file, so one task writes it; larger results go to write_sheets()."""
    documents.write(workbook_rows(merged).coalesce(1).sortWithinPartitions("sheet", "ord").select("sheet", "cells"), path, "xlsx")


def xml_escape(col: Column) -> Column:
    out = col
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(edges: DataFrame) -> DataFrame:
    """(ord, line): GraphML text of edges(src, dst), line by line; written with ``write.text`` after sorting by ord."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    spark = edges.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">']
    start = spark.createDataFrame([(0, x) for x in ["\n".join(head)]], "ord int, line string")
    node = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), xml_escape(F.col("n")), F.lit('"/>')).alias("line"))
    edge = edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), xml_escape(F.col("src")), F.lit('" target="'), xml_escape(F.col("dst")), F.lit('"/>')).alias("line"))
    end = spark.createDataFrame([(3, "</graph>\n</graphml>")], "ord int, line string")
    return start.unionByName(node).unionByName(edge).unionByName(end)


def har_entry(url: Column, status: Column, mime: Column, started: Column, millis: Column, body: Column) -> Column:
    """One HAR 1.2 entry as JSON."""
    empty = F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedDateTime"),
            millis.alias("time"),
            F.struct(F.lit("GET").alias("method"), url.alias("url"), F.lit("HTTP/1.1").alias("httpVersion"), empty.alias("headers")).alias("request"),
            F.struct(status.alias("status"), F.struct(F.octet_length(body).alias("size"), mime.alias("mimeType"), body.alias("text")).alias("content")).alias("response"),
        )
    )


def script_safe_json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def html_report(row: dict) -> str:
    """An HTML page for one merged document."""
    e = lambda s: _html.escape(str(s or ""))
    items = "".join(f'<li><a href="{e(x["href"])}">{e(x["text"])}</a></li>' for x in row.get("links") or [])
    heads = "".join(f"<li>h{int(h['level'])}: {e(h['text'])}</li>" for h in row.get("headings") or [])
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(row.get('title'))}</title></head><body><h1>{e(row.get('title'))}</h1>"
        f"<p>{e(row.get('url'))} — confidence {e(row.get('confidence_score'))}</p><p>{e(row.get('description'))}</p>"
        f"<h2>Headings</h2><ul>{heads}</ul><h2>Links</h2><ul>{items}</ul>"
        f"<script type='application/json'>{script_safe_json({'url': row.get('url'), 'title': row.get('title')})}</script></body></html>"
    )


def html_reports(merged: DataFrame) -> DataFrame:
    """(url, html) for every document."""

    def render(url, title, description, score, links, headings):
        return html_report({"url": url, "title": title, "description": description, "confidence_score": score, "links": [x.asDict() if hasattr(x, "asDict") else x for x in links or []], "headings": [x.asDict() if hasattr(x, "asDict") else x for x in headings or []]})

    return merged.select("url", slices.by_rows(render, "string")("url", "title", "description", "confidence_score", "links", "headings").alias("html"))


def write_audit(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("overwrite").partitionBy("conflict").json(path)


def write_raw(records: DataFrame, path: str) -> None:
    """Records by engine, long texts cut to previews."""
    records.withColumn("raw_html", F.substring("raw_html", 1, 1000)).write.mode("overwrite").partitionBy("engine_id").json(path)


def expired(reports: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    return reports.where(F.col(ts) < now - F.make_dt_interval(hours=F.lit(hours)))


SECRET_COLUMNS = ("severity", "pattern_name", "match_preview", "source_type", "source_url", "line_context")


def write_secrets_csv(findings: DataFrame, path: str) -> None:
    """Findings as quoted CSV with a header."""
    findings.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SECRET_COLUMNS]).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_all(merged: DataFrame, path: str) -> dict[str, str]:
    """Every report format below ``path``: kind -> where it is."""
    places = {kind: f"{path}/{kind}" for kind in ("json", "csv", "sheets", "xlsx", "html")}
    write_json(merged, places["json"])
    write_csv(merged, places["csv"])
    write_sheets(merged, places["sheets"])
    write_workbook(merged, places["xlsx"])
    html_reports(merged).write.mode("overwrite").parquet(places["html"])
    return places
