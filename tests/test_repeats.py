"""Pages that share a URL."""

from __future__ import annotations

from collections import Counter

import duckdb

from weftline.plans.catalog import QUERIES


def _both(spark, tmp_path, name: str, pages: list[tuple]) -> tuple[Counter, Counter]:
    """Rows of a query and of its SQL, by one thread, over pages(page_id, url, html)."""
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    fn, sql = QUERIES[name]
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = fn(spark, str(tmp_path))
    want = con.sql(sql)
    return Counter(map(tuple, got.collect())), Counter(tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall())


def _page(k: int, url: str, body: str, links: int, lang: str = "en") -> tuple:
    return k, url, f"<html lang='{lang}'><title>t{k}</title><h1>h</h1><p>{body}</p>" + "".join(f"<a href='/{i}'>x</a>" for i in range(links)) + "</html>"


def test_snapshots_multiply_as_in_sql(spark, tmp_path):
    got, want = _both(spark, tmp_path, "compact_snapshots", [_page(4, "http://a/", "one", 2), _page(8, "http://a/", "two", 5, "de"), _page(12, "http://b/", "three", 1)])
    assert got == want and sum(got.values()) == 9


def test_passthrough_takes_the_first_page(spark, tmp_path):
    pages = [_page(k, f"http://{k % 50}/", "text", 1 + k * 7 % 11) for k in range(100)]
    got, want = _both(spark, tmp_path, "crawl_passthrough", pages[50:] + pages[:50][::-1])
    assert {u: n for u, _, n in got} == {f"http://{k}/": 1 + k * 7 % 11 for k in range(50)} and len(want) == 50
    (tmp_path / "in_order").mkdir()
    got, want = _both(spark, tmp_path / "in_order", "crawl_passthrough", pages)
    assert got == want


def test_longest_value_takes_the_first_page_of_a_tie(spark, tmp_path):
    got, _ = _both(spark, tmp_path, "longest_value", [_page(8, "http://a/", "zzzz b", 0), _page(4, "http://a/", "aaaa b", 0), _page(12, "http://b/", "only", 0)])
    assert {u: v.split()[-2] for u, v, _ in got if u == "http://a/"} == {"http://a/": "aaaa"}
