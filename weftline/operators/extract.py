"""HTML extraction: each page is parsed once, for exactly the fields that a query asks for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html_ops, slices
from ..functions.html_dom import parse

_WITH_BASE = {"links", "images", "zones"}


def fields(html: Column, url: Column, names: Iterable[str]) -> Column:
    """Struct of the named fields (of schemas.PAGE_FIELDS) from one parse of the page."""
    names = list(names)

    def run(page: str, base: str) -> dict:
        doc = parse(page)
        return {n: getattr(html_ops, n)(doc, base or "") if n in _WITH_BASE else getattr(html_ops, n)(doc) for n in names}

    kind = "struct<" + ",".join(f"{n}:{schemas.PAGE_FIELDS[n]}" for n in names) + ">"
    return slices.by_rows(run, kind)(html, url)


def extract(pages: DataFrame, options: Iterable[str], css: str = "", xpath: str = "", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """All other columns of ``pages`` and one column for each option; custom_css and custom_xpath if given.

    Null pages give empty fields.
    """
    options = list(options)
    unknown = [o for o in options if o not in schemas.PAGE_FIELDS]
    if unknown:
        raise ValueError(f"unknown options: {unknown}")
    keep = [c for c in pages.columns if c != html_col and c not in options]
    cols = [F.col(c) for c in keep]
    page = fields(F.col(html_col), F.col(url_col), options) if options else F.lit(None)
    out = pages.select(*cols, page.alias("_page"), *([select_css(F.col(html_col), F.col(url_col), css).alias("custom_css")] if css else []), *([select_xpath(F.col(html_col), xpath).alias("custom_xpath")] if xpath else []))
    return out.select(*keep, *[F.col(f"_page.{o}") for o in options], *(["custom_css"] if css else []), *(["custom_xpath"] if xpath else []))


def select_css(html: Column, url: Column, selector: str) -> Column:
    """Elements that match a CSS selector. A selector outside the supported subset raises ValueError at once."""
    html_ops.css(parse(""), selector)
    return slices.by_rows(lambda page, base: html_ops.css(parse(page), selector, base or ""), f"array<{schemas.MATCH}>")(html, url)


def select_xpath(html: Column, expression: str) -> Column:
    html_ops.xpath_matches(parse("<p></p>"), expression)
    return slices.by_rows(lambda page: html_ops.xpath_matches(parse(page), expression), f"array<{schemas.MATCH}>")(html)


# ---------------------------------------------------------------- native fast paths
def native_links(html: Column) -> Column:
    """Anchor targets by pattern, as array<struct<href, text>>; no tree is built."""
    pairs = r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*["']([^"'>]*)["'][^>]*>(.*?)</a>"""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pairs), F.lit(1))
    texts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pairs), F.lit(2))
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " "))
    return F.zip_with(hrefs, texts, lambda h, t: F.struct(F.trim(h).alias("href"), plain(t).alias("text")))


#: Start tags of paragraphs, and what ends one. Alternations inside loops would overflow Java's regex stack on long pages.
PARAGRAPH_START = r"(?is)<p\b[^>]*>"
PARAGRAPH_END = r"(?is)</?(p|div|article|section|main|footer|ul|ol|table|body|html)\b.*$"
SCRIPTS = r"(?is)<(script|style)\b.*?</(script|style)>"


def native_paragraphs(html: Column) -> Column:
    """Paragraph texts by pattern: from a start tag to the next block element's tag."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), SCRIPTS, " ")
    pieces = F.split(body, PARAGRAPH_START)
    raw = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda t: F.regexp_replace(t, PARAGRAPH_END, ""))
    return F.filter(F.transform(raw, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " "))), lambda t: t != "")
