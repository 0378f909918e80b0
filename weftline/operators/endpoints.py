"""Endpoints that pages and scripts name: forms, links, comments, inline scripts, script files; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import urls

#: Largest inline script that is looked at.
SCRIPT_CHARS = 1_000_000
#: Where the call that a pattern found may say "post": so many characters before it, and the first of its own.
_BEFORE, _AFTER = 10, 4
FORM = r"(?is)<form\b([^>]*)>(.*?)</form"
SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script"
FIELD = r"""(?is)<(?:input|select|textarea)\b[^>]*?\bname\s*=\s*["']([^"']+)["']"""
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""
COMMENT = r"(?s)<!--(.*?)-->"
DESCRIBED = r"""(?is)<link\b[^>]*?\brel\s*=\s*["'][^"']*\bdescribedby\b[^"']*["'][^>]*?\bhref\s*=\s*["']([^"']+)["']"""
_ENTRY = "array<struct<source: string, method: string, raw: string, params: string>>"


def attribute(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, rf"""(?is)(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1)


def _entry(source, method, raw: Column, params: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(source).alias("source"), lit(method).alias("method"), raw.alias("raw"), (F.lit("") if params is None else params).alias("params"))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _rows(pages: DataFrame, entries: Column, base: str, keys: list[str]) -> DataFrame:
    """Each page's endpoints, a URL once, the first that names it."""
    rows = pages.select(*keys, F.col(base).alias("base"), F.posexplode(entries).alias("pos", "e")).withColumn("url", urls.normalize_probe(F.col("e.raw"), F.col("base"))).where("url IS NOT NULL")
    first = rows.groupBy(*keys, "base", "url").agg(F.min_by("e", "pos").alias("e"))
    return first.select(*keys, "url", "e.method", "e.source", "e.params", (~urls.same_origin(F.col("url"), F.col("base"))).alias("external"))


def in_pages(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """(keys, url, method, source, params, external) of forms, API-like links, comments and inline scripts, in this order.

    A form without an action stands for the page itself; params are the names of its fields, comma-joined.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    api = lambda u: F.rlike(u, F.lit(C.API_HREF))
    forms = F.zip_with(_all(h, FORM, 1), _all(h, FORM, 2), lambda a, b: _entry("form", F.upper(F.coalesce(F.nullif(attribute(a, "method"), F.lit("")), F.lit("get"))), F.coalesce(F.nullif(attribute(a, "action"), F.lit("")), F.col(url)), F.array_join(_all(b, FIELD), ",")))
    links = F.transform(F.filter(_all(h, ANCHOR), api), lambda u: _entry("html_href", "GET", u))
    noted = F.flatten(F.transform(_all(h, COMMENT), lambda c: F.filter(_all(c, C.COMMENT_URL, 0), api)))
    comments = F.transform(noted, lambda u: _entry("html_comment", "GET", u))
    inline = F.filter(F.zip_with(_all(h, SCRIPT, 1), _all(h, SCRIPT, 2), lambda a, b: F.when(~F.rlike(a, F.lit(r"(?i)(?:^|\s)src\s*=")) & (F.char_length(b) <= SCRIPT_CHARS), b)), lambda s: s.isNotNull())
    called = lambda s: F.concat(*[_all(s, p) for p in C.JS_PATTERNS.values()])
    scripts = F.transform(F.filter(F.flatten(F.transform(inline, called)), lambda u: api(u) | F.startswith(u, F.lit("/"))), lambda u: _entry("js_inline", "GET", u))
    return _rows(pages, F.concat(*[x.cast(_ENTRY) for x in (forms, links, comments, scripts)]), url, keys)


def described_by(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """(keys, spec_url): the last API description that a page links to."""
    found = F.try_element_at(_all(F.coalesce(F.col(html), F.lit("")), DESCRIBED), F.lit(-1))
    some = pages.where(F.rlike(html, F.lit(DESCRIBED)))
    return some.select(*keys, urls.normalize_probe(found, F.col(url)).alias("spec_url")).where("spec_url IS NOT NULL")


def in_scripts(scripts: DataFrame, keys: list[str], base: str = "url", js: str = "js") -> DataFrame:
    """The same columns for script files: WebSockets, source maps, then calls and routes. Calls of local hosts are left out.

    A call is a POST if the text right before it, or its own beginning, says so.
    """
    s = F.coalesce(F.col(js), F.lit(""))
    sockets = F.transform(_all(s, C.WEBSOCKET), lambda u: _entry("js_websocket", "WS", u))
    maps = F.transform(_all(s, C.SOURCE_MAP), lambda u: _entry("source_map", "GET", F.trim(u)))

    def calls(pattern: str) -> Column:
        flags, body = pattern.split(")", 1)
        around = rf"{flags})((?s:.{{0,{_BEFORE}}}?)){body}"
        whole = F.zip_with(_all(s, around, 1), _all(s, around, 0), lambda a, w: F.left(w, F.char_length(a) + _AFTER))
        both = F.zip_with(whole, _all(s, around, 2), lambda w, u: _entry(F.when(F.startswith(u, F.lit("http")), "absolute").otherwise("js_regex"), F.when(F.contains(F.lower(w), F.lit("post")), "POST").otherwise("GET"), u))
        return F.filter(both, lambda e: (F.char_length(e["raw"]) >= 2) & ~F.rlike(e["raw"], F.lit(r"^http://(?:localhost|127\.)")))

    rows = _rows(scripts, F.concat(*[x.cast(_ENTRY) for x in (sockets, maps, *map(calls, C.JS_PATTERNS.values()))]), base, keys)
    named = F.when(F.col("source") != "absolute", F.col("source")).when(F.col("external"), "js_external").otherwise("js_regex")
    return rows.withColumn("source", named)


def distinct(endpoints: DataFrame, order: Column, keys: list[str]) -> DataFrame:
    """One endpoint for each URL and method within ``keys``: the first in ``order``. Partial aggregates, so a common endpoint is no hot key."""
    rest = [c for c in endpoints.columns if c not in ("url", "method", *keys)]
    return endpoints.groupBy(*keys, "url", "method").agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "url", "method", "r.*")
