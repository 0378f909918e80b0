"""Endpoint passes and robots rules on hand-made pages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.operators import endpoints
from weftline.plans.queries_pages import robots_allowed

BASE = "https://shop.example.com/a/b"


def test_pages(spark):
    html = """<FORM METHOD='Post' action='../save?b=2&a=1'><input name="x"><textarea name='y'></textarea></FORM><form></form>
    <a class="k" href="https://api.example.com/v1/items">x</a><a href='/api/v1/one'>1</a><a href="/plain">p</a><a href="/api/v1/one#frag">again</a>
    <!-- old: /api/v0/gone, http://h.example.com/rest/q and /just/a/path --> <a href="javascript:/api/">no</a>
    <script>fetch('/api/v1/one'); fetch(`/late`); axios.post("/api/v2/order")</script><script src="/x.js">fetch("/hidden")</script>
    <link rel="alternate describedby" href="/spec.json">"""
    pages = spark.createDataFrame([(1, BASE, html), (2, BASE, None), (3, BASE, "")], "page_id long, url string, html string")
    got = {(r["url"], r["method"], r["source"], r["params"], r["external"]) for r in endpoints.in_pages(pages, ["page_id"]).collect()}
    o = "https://shop.example.com"
    assert got == {
        (f"{o}/save?a=1&b=2", "POST", "form", "x,y", False),
        (f"{o}/a/b", "GET", "form", "", False),
        ("https://api.example.com/v1/items", "GET", "html_href", "", True),
        (f"{o}/api/v1/one", "GET", "html_href", "", False),
        (f"{o}/api/v0/gone", "GET", "html_comment", "", False),
        ("http://h.example.com/rest/q", "GET", "html_comment", "", True),
        (f"{o}/late", "GET", "js_inline", "", False),
        (f"{o}/api/v2/order", "GET", "js_inline", "", False),
    }
    assert [tuple(r) for r in endpoints.described_by(pages, ["page_id"]).collect()] == [(1, f"{o}/spec.json")]


def test_scripts(spark):
    js = 'const post = fetch("/api/a"); axios.get("/api/b"); axios.get("/api/a"); fetch("http://127.0.0.1/x"); fetch("x"); fetch("https://o.example.org/y"); new WebSocket("wss://w.example.org/s")\n//# sourceMappingURL=m.js.map'
    rows = endpoints.in_scripts(spark.createDataFrame([(1, BASE, js), (2, BASE, None)], "page_id long, url string, js string"), ["page_id"])
    assert {(r["url"], r["method"], r["source"], r["external"]) for r in rows.collect()} == {
        ("https://shop.example.com/api/a", "POST", "js_regex", False),
        ("https://shop.example.com/api/b", "GET", "js_regex", False),
        ("https://o.example.org/y", "GET", "js_external", True),
        ("wss://w.example.org/s", "WS", "js_websocket", True),
        ("https://shop.example.com/a/m.js.map", "GET", "source_map", False),
    }
    two = rows.unionByName(rows.withColumn("source", F.lit("later")))
    one = endpoints.distinct(two, F.when(F.col("source") == "later", 1).otherwise(0), [])
    assert one.count() == 5 and one.where("source = 'later'").count() == 0


def test_robots_rules(spark):
    r = random.Random(2)
    path = lambda: "/" + "/".join(r.choice("ab") for _ in range(r.randint(0, 4)))
    rules = [(r.choice("gh"), path()[: r.randint(1, 9)], r.random() < 0.5) for _ in range(30)] + [("g", "", False)]
    pages = [(k, r.choice("ghi"), path()) for k in range(300)]
    got = robots_allowed(spark.createDataFrame(pages, "page_id long, grp string, path string"), spark.createDataFrame(rules, "grp string, prefix string, allow boolean"))

    def plain(g, p):
        hit = [(len(x), a) for grp, x, a in rules if grp == g and p.startswith(x)]
        return max(hit)[1] if hit else True

    assert {x["page_id"]: x["allowed"] for x in got.collect()} == {k: plain(g, p) for k, g, p in pages}
