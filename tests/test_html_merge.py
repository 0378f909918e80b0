"""Goldens of the element tree, extraction and merging."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.functions import html_ops as H
from weftline.functions.html_dom import parse, select, xpath
from weftline.operators import extract, merge_fold as M
from weftline.plans import pipeline

PAGE = """<html lang="en"><head><title> A  Test Page for Extraction </title><meta name="description" content="A description that is long enough to pass the check of fifty characters.">
<meta property="og:title" content="OG title"><meta property="og:type" content="article"><link rel="canonical" href="/canon"><meta name="keywords" content="a, b ,c">
<script type="application/ld+json">[{"@type":"Article"},{"@type":"Person"}]</script><script type="application/ld+json">{bad</script></head>
<body><nav class="navbar"><a href="/x">X</a><a href="javascript:void(0)">J</a><a href="/x">again</a></nav><main><h1>Main Heading</h1><h1>main heading</h1>
<p>One paragraph<p>Two <b>bold</b> words<p>Three more words<ul><li>first<li>second</ul><ol><li>1</ol>
<table><tr><th>H1<th>H2<tr><td>1<td>2<tr><td><table><tr><td>inner</table></table>
<img data-src="i.png" alt=z><img src="data:x"><picture><source srcset="p.webp 1x, q.webp 2x"><img alt=pic></picture>
<form action="/f" method=post><input name=q required><input type=hidden name=h></form><div role="form"><input name="r"></div><input name=loose>
<button data-href="/b">B</button><div onclick="window.location = '/oc'">C</div></main>
<footer class="footer">call +1 415 555 2671 or a@b.com</footer>"""


def test_fields():
    d = parse(PAGE)
    assert H.title(d) == "A Test Page for Extraction"
    assert [h["text"] for h in H.headings(d)] == ["Main Heading"] and H.headings(d)[0]["importance"] > 6
    assert H.paragraphs(d) == ["One paragraph", "Two bold words", "Three more words"]
    assert [x["href"] for x in H.links(d, "http://e.com/a")] == ["http://e.com/x", "http://e.com/b", "http://e.com/oc"]
    assert [x["src"] for x in H.images(d, "http://e.com/a/")] == ["http://e.com/a/p.webp", "http://e.com/a/i.png"]
    t = H.tables(d)
    assert t[0]["headers"] == ["H1", "H2"] and t[0]["rows"][0] == ["1", "2"] and t[1]["rows"] == [["inner"]]
    assert H.lists(d) == [{"type": "ul", "items": ["first", "second"]}, {"type": "ol", "items": ["1"]}]
    forms = H.forms(d)
    assert [f["type"] for f in forms] == ["html_form", "aria_form", "implicit_inputs"] and forms[0]["method"] == "POST" and forms[0]["fields"][0]["required"]
    assert [x["name"] for x in forms[2]["fields"]] == ["loose"]
    assert H.json_ld(d) == ['{"@type": "Article"}', '{"@type": "Person"}']
    assert H.opengraph(d) == {"og:title": "OG title", "og:type": "article"}
    z = H.zones(d, "http://e.com")
    assert set(z) == {"navbar", "content", "footer"} and z["navbar"]["links"][0]["href"] == "http://e.com/x"
    assert H.entities(d)["organization"] == "Main Heading"


def test_main_content_prefers_landmark_then_density():
    long = "word " * 60
    assert H.main_content(parse(f"<div><p>{long}</p></div><main>{long}x</main>")).endswith("x")
    assert H.main_content(parse(f"<div class=sidebar>{long}</div><div><p>{long}</p></div>")) == long.strip()
    assert H.main_content(parse("<p>a<p>b")) == "a b" and H.main_content(parse("")) == "" and H.main_content(parse(None)) == ""


def test_selectors():
    d = parse(PAGE)
    assert [n.tag for n in select(d, "main > h1, ul li:first-child, [role=form] input")] == ["h1", "h1", "li", "input"]
    assert len(select(d, "nav.navbar a[href^='/']")) == 2 and xpath(d, "//img[@alt='pic']/@alt") == ["pic"]
    assert [n.words() for n in xpath(d, "//ul/li[2]")] == ["second"]


def test_odd_markup_does_not_fail():
    for page in ("<p>" * 3000, "<div>" * 3000 + "x", "<!DOCTYPE", "<![CDATA[", "<a href=>", "</p></p>", "<title>\U0001f600</title>", "\x00<p>"):
        H.everything(page, "http://[bad")


def test_fold_goldens():
    assert M.levenshtein("kitten", "sitting") == 3 and M.similarity("", "") == 1.0
    names = ["Acme Corp", "Acme Corp.", "Widgets Inc", "Widgets Inc.", "Zeta"]
    assert [len(g) for g in M.clusters(names, 0.6)] == [2, 2, 1]
    assert M.simhash("the quick, brown fox!") == M.simhash("quick brown fox")
    ok = {"success": True}
    assert M.reliability([ok, {"success": False}]) == 0.5
    assert M.reliability([{"success": True, "warnings": ["timeout", "404"]}]) == 0.92
    assert M.reliability([{"success": True, "warnings": ["timeout"] * 20}]) == 0.75
    assert M.quality("links", [{"href": "http://a"}, {"href": "javascript:x"}], {}) == 0.5
    assert M.weight("structured_metadata") == 1.0 and M.weight("other") == 0.70
    assert M.vote(["acme", "", "acme!", "zeta"], ["static_requests", "static_urllib", "static_httpx", "ai_assist"])[0] in (0, 2)
    assert M.vote(["zeta", "alpha beta", "alpha betas"], ["other", "other", "other"]) == (2, 0.667)
    assert M.vote(["one", "two"], ["other", "other"]) == (0, 0.5) and M.vote(["", ""], ["a", "b"]) == (None, 0.0)
    assert M.longest(["a b c d", "a b", "a", "  "], ["other"] * 4) == ("a b c d", 0.5) and M.longest([], []) == ("", 0.0)
    assert M.weight_share(["other", "other"], [True, False]) == 0.5 and M.weight_share([], []) == 0.0
    doc = M.fold([{"url": "u", "engine_id": "static_requests", "success": True, "title": "Good title here"}, {"url": "u", "engine_id": "static_httpx", "success": True, "title": "Good title hare"}])
    assert doc["conflicting_fields"] == ["title"] and doc["engines_used"] == 2
    assert M.fold([])["confidence_score"] == 0.0


def test_levenshtein_twin():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))

    r = random.Random(3)
    for _ in range(60):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(2))
        assert M.levenshtein(a, b) == slow(a, b)


def test_pipeline_is_independent_of_order(spark):
    rows = [(f"http://e.com/{k}", PAGE.replace("Test", f"Test{k}")) for k in range(6)] + [("http://e.com/null", None), ("http://e.com/empty", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    cols = ["url", "title", "language", "page_type", "canonical_url", "confidence_score", "content_hash", "description"]
    a = sorted(map(tuple, pipeline.run_pipeline(pages).select(*cols).collect()))
    b = sorted(map(tuple, pipeline.run_pipeline(pages.repartition(5)).select(*cols).collect()))
    assert a == b and len(a) == 8
    first = next(r for r in a if r[0].endswith("/0"))
    assert first[1] == "A Test0 Page for Extraction" and first[2] == "en" and first[4] == "http://e.com/canon" and 0 < first[5] <= 1


def test_extract_options(spark):
    pages = spark.createDataFrame([(1, "http://e.com", PAGE)], "page_id long, url string, html string")
    got = extract.extract(pages, ["title", "links"], css="h1", xpath="//h1/text()").first()
    assert got["title"] == "A Test Page for Extraction" and len(got["custom_css"]) == 2 and got["custom_xpath"][0]["text"] == "Main Heading"
    for bad in (lambda: extract.extract(pages, ["nope"]), lambda: extract.extract(pages, [], css="a:hover(")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError


def test_audit_and_gate(spark):
    pages = spark.createDataFrame([("http://e.com/1", PAGE), ("http://e.com/2", "<p>x")], "url string, html string")
    m = pipeline.merge(pipeline.engine_results(pages))
    d = pipeline.decisions(m)
    assert d.where("reason = 'longest_with_overlap'").count() == 4
    better = m.withColumn("confidence_score", F.lit(0.9))
    gated = pipeline.confidence_gate(m.withColumn("confidence_score", F.when(F.col("url").endswith("2"), 0.1).otherwise(0.5)), better)
    assert {r["url"][-1]: r["confidence_score"] for r in gated.collect()} == {"1": 0.5, "2": 0.9}
