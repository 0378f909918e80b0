"""Classifiers of pages, endpoints and errors as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import urls
from .text import nonempty, rx, sanitize


def title(html: Column) -> Column:
    return sanitize(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1))


def language(html: Column) -> Column:
    """Language attribute of the html element, else the content-language meta tag, in the first 4096 characters; null if neither."""
    head = F.substring(F.coalesce(html, F.lit("")), 1, 4096)
    found = [nonempty(F.trim(F.regexp_extract(head, p, 1))) for p in (C.LANG_ATTRIBUTE, C.LANG_META, C.LANG_META_REVERSED)]
    return F.coalesce(*found)


def canonical(url: Column, html: Column) -> Column:
    """Resolved canonical link in the first 16384 characters; null if there is none."""
    head = F.substring(F.coalesce(html, F.lit("")), 1, 16384)
    href = F.coalesce(nonempty(F.regexp_extract(head, C.CANONICAL, 1)), nonempty(F.regexp_extract(head, C.CANONICAL_REVERSED, 1)))
    return F.when(href.isNotNull(), urls.resolve(url, href))


def page_type(url: Column, html: Column) -> Column:
    """Open Graph type, then JSON-LD type, then the URL, then an article or main element."""
    h = F.coalesce(html, F.lit(""))
    og, ld = F.regexp_extract(h, C.OG_TYPE, 1), F.regexp_extract(h, C.LD_TYPE, 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "unknown")
        .when(F.contains(og, F.lit("article")), "article")
        .when(F.contains(og, F.lit("product")), "product")
        .when(og.isin("website", "website:home"), "homepage")
        .when(ld.isin("Article", "BlogPosting", "NewsArticle"), "article")
        .when(ld == "Product", "product")
        .when(ld.isin("WebPage", "HomePage", "WebSite"), "homepage")
        .when(rx(url, C.PAGE_HOME), "homepage")
        .when(rx(url, C.PAGE_BLOG), "blog_post")
        .when(rx(url, C.PAGE_PRODUCT), "product")
        .when(rx(url, C.PAGE_SEARCH), "search_results")
        .when(rx(url, C.PAGE_CONTACT), "contact")
        .when(rx(F.substring(h, 1, C.CAPS["raw_html"]), C.PAGE_ARTICLE), "article")
        .otherwise("unknown")
    )


def _any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def is_spa(html: Column) -> Column:
    return _any(F.lower(F.coalesce(html, F.lit(""))), C.SPA_SIGNATURES)


def has_api_calls(html: Column) -> Column:
    return _any(F.lower(F.coalesce(html, F.lit(""))), C.API_SIGNATURES)


def site_type(html: Column, content_type: Column | None = None) -> Column:
    """file, spa, mixed or static."""
    file = F.lit(False) if content_type is None else _any(F.lower(F.coalesce(content_type, F.lit(""))), C.FILE_CONTENT_TYPES)
    return F.when(file, "file").when(is_spa(html), "spa").when(has_api_calls(html), "mixed").otherwise("static")


def selected_engines(site: Column, spa: Column, api: Column, skip: Column | None = None) -> Column:
    """Extraction strategies for a page, in order."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    base = F.concat(lits(C.SELECT_ALWAYS), F.when(spa | api, lits(C.SELECT_JS)).otherwise(F.array().cast("array<string>")), lits(C.SELECT_EXTENDED))
    browser = F.arrays_overlap(base, lits(C.SELECT_BROWSER))
    chosen = F.when(site == "file", lits(C.SELECT_FILE)).when(browser, F.array_except(base, lits(("hybrid",)))).otherwise(base)
    return F.array_distinct(chosen) if skip is None else F.array_except(chosen, skip)


def captcha(html: Column) -> Column:
    """cloudflare (two signs), turnstile, hcaptcha, recaptcha_v3, recaptcha_v2 or null."""
    h = F.coalesce(html, F.lit(""))
    signs = reduce(lambda a, b: a + b, [rx(h, p).cast("int") for p in C.CAPTCHA_CLOUDFLARE])
    return (
        F.when(signs >= 2, "cloudflare")
        .when(rx(h, C.CAPTCHA_TURNSTILE), "turnstile")
        .when(rx(h, C.CAPTCHA_HCAPTCHA), "hcaptcha")
        .when(rx(h, C.CAPTCHA_V3), "recaptcha_v3")
        .when(rx(h, C.CAPTCHA_V2), "recaptcha_v2")
    )


def sitekey(html: Column) -> Column:
    h = F.coalesce(html, F.lit(""))
    return F.coalesce(*[nonempty(F.regexp_extract(h, p, 1)) for p in C.SITEKEYS], F.lit(""))


def error_category(message: Column) -> Column:
    out = F.when(F.coalesce(message, F.lit("")) == "", "unknown")
    for name, pattern in C.ERROR_TAXONOMY:
        out = out.when(rx(message, pattern), name)
    return out.otherwise("unknown")


def error_code(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(low == "", "E901")
    for words, code in C.ERROR_WORDS:
        out = out.when(_any(low, words), code)
    return out.otherwise("E901")


def is_transient(message: Column) -> Column:
    return _any(F.lower(F.coalesce(message, F.lit(""))), C.TRANSIENT_WORDS)


def endpoint_risk(url: Column, source: Column, auth: Column, cors: Column, status: Column, content_type: Column) -> Column:
    """HIGH, MEDIUM, LOW or INFO; the first rule that holds decides. auth null: unknown."""
    open_ = F.coalesce(~auth, F.lit(False))
    return (
        F.when(source == "graphql_introspection", "MEDIUM")
        .when(rx(urls.path(url), C.SENSITIVE_PATH), F.when(open_, "HIGH").otherwise("MEDIUM"))
        .when((status == 200) & open_, F.when(F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("json")), "HIGH").otherwise("MEDIUM"))
        .when(cors & open_, "HIGH")
        .when(cors, "MEDIUM")
        .when(status.isin(401, 403), "LOW")
        .otherwise("INFO")
    )


def risk_reason(url: Column, source: Column, auth: Column, cors: Column, status: Column, content_type: Column) -> Column:
    open_ = F.coalesce(~auth, F.lit(False))
    quoted = F.concat(F.lit("Sensitive path '"), urls.path(url), F.lit("'"))
    return (
        F.when(source == "graphql_introspection", "GraphQL introspection enabled — schema is fully exposed")
        .when(
            rx(urls.path(url), C.SENSITIVE_PATH),
            F.when(open_, F.concat(quoted, F.lit(" is unauthenticated and accessible"))).otherwise(F.concat(quoted, F.lit(" found — verify access control"))),
        )
        .when(
            (status == 200) & open_,
            F.when(F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("json")), "Unauthenticated API endpoint returning JSON — data exposed").otherwise(
                "Unauthenticated endpoint returning 200 — verify data sensitivity"
            ),
        )
        .when(cors & open_, "CORS wildcard on unauthenticated endpoint — cross-origin data access possible")
        .when(cors, "CORS wildcard configured — may allow cross-origin data access")
        .when(status.isin(401, 403), "Endpoint exists but requires authentication")
        .when(source == "js_external", "Third-party API URL found in JavaScript — not probed")
        .when(source.isin("form", "html_href", "html_comment"), F.concat(F.lit("Endpoint found via "), source))
        .otherwise("Endpoint identified — manual review recommended")
    )
