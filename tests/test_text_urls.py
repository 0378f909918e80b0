"""Goldens of text, URL and classifier functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.functions import classify, text, urls


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def lits(*values):
    return [F.lit(v) for v in values]


def test_similarity(spark):
    got = one(spark, F.levenshtein(*lits("kitten", "sitting")), text.lev_similarity(*lits("cat", "cats")), text.lev_similarity(*lits("", "")))
    assert tuple(got) == (3, 0.75, 1.0)


@pytest.mark.parametrize(
    ("value", "noise"), [("123", True), ("1234", False), ("Loading...", True), ("Read More", True), ("Copyright 2024", True), ("A real sentence", False), (None, True)]
)
def test_noise(spark, value, noise):
    assert one(spark, text.is_noise(F.lit(value).cast("string")))[0] is noise


@pytest.mark.parametrize(
    ("mail", "reason"),
    [("a@b.co", "ok"), ("", "empty"), ("x" * 250 + "@b.co", "too_long"), ("a.b.co", "invalid_at"), ("a@b@c.co", "invalid_at"), ("y" * 65 + "@b.co", "local_too_long"), ("a b@c.co", "invalid_format"), ("a@b", "invalid_format"), (None, "empty")],
)
def test_email_reason(spark, mail, reason):
    assert one(spark, text.email_reason(F.lit(mail).cast("string")))[0] == reason


def test_entities(spark):
    t = "Call +1 (415) 555-2671 or 415 555 2671; write a@b.com, a@b.com. 12 Main Street, Springfield; ok."
    phones, mails, places = one(spark, text.phones(F.lit(t)), text.emails(F.lit(t)), text.address_sentences(F.lit(t)))
    assert mails == ["a@b.com"] and "12 Main Street, Springfield" in places and len(phones) >= 1


def test_overlap(spark):
    a, b = text.tokens(F.lit("The quick brown fox")), text.tokens(F.lit("quick red fox"))
    assert one(spark, text.overlap_f1(a, b), text.overlap_f1(a, text.tokens(F.lit(""))))[:] == (0.6667, 0.0)


@pytest.mark.parametrize(
    ("html", "lang"),
    [('<html lang="fr-CA">', "fr-CA"), ("<html class=x lang='en-us'>", "en-us"), ('<meta http-equiv="content-language" content="es">', "es"), ('<meta content="de-DE" http-equiv="content-language">', "de-DE"), ("<html>", None), (None, None)],
)
def test_language(spark, html, lang):
    assert one(spark, classify.language(F.lit(html).cast("string")))[0] == lang


@pytest.mark.parametrize(
    ("url", "html", "kind"),
    [
        ("https://e.com/", "", "homepage"),
        ("https://e.com/index.html", "", "homepage"),
        ("https://e.com/blog/x", "", "blog_post"),
        ("https://e.com/shop/x", "", "product"),
        ("https://e.com/s?q=a", "", "search_results"),
        ("https://e.com/contact", "", "contact"),
        ("https://e.com/x", "<article>", "article"),
        ("https://e.com/x", '<meta property="og:type" content="product.item">', "product"),
        ("https://e.com/x", "", "unknown"),
        ("", "<article>", "unknown"),
    ],
)
def test_page_type(spark, url, html, kind):
    assert one(spark, classify.page_type(F.lit(url), F.lit(html)))[0] == kind


@pytest.mark.parametrize(
    ("html", "kind"),
    [("<p>plain</p>", "static"), ('<div id="root" data-reactroot>', "spa"), ('<script id="__NEXT_DATA__">', "spa"), ("<app ng-version=1>", "spa"), ("<script>fetch('/x')</script>", "mixed")],
)
def test_site_type(spark, html, kind):
    assert one(spark, classify.site_type(F.lit(html)))[0] == kind


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://E.com/a/?utm_source=x&b=2&a=1#f", "http://e.com/a?a=1&b=2"),
        ("http://e.com", "http://e.com/"),
        ("http://e.com/a//", "http://e.com/a"),
    ],
)
def test_crawl_key(spark, url, key):
    assert one(spark, urls.normalize_crawl(F.lit(url)))[0] == key


@pytest.mark.parametrize("href", ["/x", "x", "../x", "./x", "//o.com/x", "https://o.com/y", "?q=1", "#top", "", "a/../b", "../../../z"])
def test_resolve(spark, href):
    from urllib.parse import urljoin

    base = "http://e.com/a/b?c=d#e"
    want = urljoin(base, href) if href else "http://e.com/a/b?c=d"
    assert one(spark, urls.resolve(F.lit(base), F.lit(href)))[0] == want


@pytest.mark.parametrize(
    ("url", "reason"),
    [
        ("http://8.8.8.8/", "ok"),
        ("http://10.1.2.3/", "private_address"),
        ("http://u@172.16.0.1:80/", "private_address"),
        ("http://localhost/", "blocked_host"),
        ("ftp://e.com", "bad_scheme"),
        ("", "empty"),
        ("http:///x", "no_host"),
        ("http://e.com/" + "a" * 2100, "too_long"),
    ],
)
def test_validate(spark, url, reason):
    assert one(spark, urls.invalid_reason(F.lit(url)))[0] == reason


def test_scores(spark):
    u = lambda s: F.lit(s)
    got = one(spark, urls.api_score(u("http://e.com/api/v1/users")), urls.crawl_priority(u("http://e.com/about"), F.lit(1)), urls.crawl_priority(u("http://e.com/login"), F.lit(1)))
    assert tuple(got) == (6, -1.0, 4.0)


@pytest.mark.parametrize(
    ("args", "risk"),
    [
        (("http://e.com/admin", "html", False, False, None, None), "HIGH"),
        (("http://e.com/admin", "html", None, False, None, None), "MEDIUM"),
        (("http://e.com/x", "html", False, False, 200, "application/json"), "HIGH"),
        (("http://e.com/x", "html", False, False, 200, "text/html"), "MEDIUM"),
        (("http://e.com/x", "html", None, True, 404, None), "MEDIUM"),
        (("http://e.com/x", "html", True, False, 401, None), "LOW"),
        (("http://e.com/x", "js_external", None, False, None, None), "INFO"),
        (("http://e.com/x", "graphql_introspection", None, False, None, None), "MEDIUM"),
    ],
)
def test_risk(spark, args, risk):
    kinds = ("string", "string", "boolean", "boolean", "int", "string")
    assert one(spark, classify.endpoint_risk(*[F.lit(a).cast(k) for a, k in zip(args, kinds)]))[0] == risk


@pytest.mark.parametrize(
    ("message", "category", "code"),
    [("Timeout after 30s", "timeout", "E001"), ("403 Forbidden", "bot_blocked", "E901"), ("Connection refused", "connection", "E101"), ("SSL error", "ssl_error", "E104"), ("", "unknown", "E901"), ("module x not installed", "unknown", "E701")],
)
def test_errors(spark, message, category, code):
    assert one(spark, classify.error_category(F.lit(message)), classify.error_code(F.lit(message)))[:] == (category, code)


def test_captcha(spark):
    pages = ['<div class="g-recaptcha" data-sitekey="k">', '<div class="h-captcha">', '<div class="cf-turnstile">', '<title>Just a moment...</title><form id="challenge-form">', "grecaptcha.execute(", "<p>"]
    got = [one(spark, classify.captcha(F.lit(p)))[0] for p in pages]
    assert got == ["recaptcha_v2", "hcaptcha", "turnstile", "cloudflare", "recaptcha_v3", None]


def test_keywords_shuffle_texts_once(spark, tmp_path):
    from weftline.plans.queries_text import document_keywords

    rows = [(k, f"alpha beta{'x' * k} alpha gamma") for k in (1, 2, 3)] + [(1, "gamma delta gamma")]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "20L AS n_chars").write.parquet(str(path))
    got = document_keywords(spark, str(tmp_path))
    assert {(r["doc_id"], r["word"], r["n"]) for r in got.collect()} == {(1, "alpha", 2), (1, "gamma", 3), (1, "betax"[:5], 1), (1, "delta", 1), (2, "alpha", 2), (2, "betaxx", 1), (2, "gamma", 1), (3, "alpha", 2), (3, "betaxxx", 1), (3, "gamma", 1)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
