"""Streams, crawl, near-duplicates and report files."""

from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import crawl, dedup, hamming, profile, relational
from weftline.plans import pipeline
from weftline.sources import files, sinks
from weftline.streaming import events as ev


def make_events(spark, folder, n=200):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=37 * k), k % 5, ["view", "error"][k % 3 == 0], float(k % 7), "{}") for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.repartition(4).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return spark.read.parquet(f"{folder}/events.parquet")


def test_stream_equals_batch(spark, tmp_path):
    batch = make_events(spark, f"file://{tmp_path}")
    stream = ev.read_stream(spark, f"file://{tmp_path}", files_per_trigger=1)
    for fn in (lambda d: ev.tumbling(d, "10 minutes"), ev.latest_status):
        assert sorted(map(tuple, ev.run_complete(fn(stream), "t").collect())) == sorted(map(tuple, fn(batch).collect()))
    got = ev.run_append(ev.dedup_within(stream, ["user_id", "event_type"], "1 day"), "d")
    assert got.count() == batch.select("user_id", "event_type").distinct().count()


def test_token_bucket(spark, tmp_path):
    batch = make_events(spark, f"file://{tmp_path}", 120)
    got = ev.run_append(ev.token_bucket(ev.read_stream(spark, f"file://{tmp_path}", files_per_trigger=100), 2.0, 1 / 600), "b")
    admitted = {r["event_id"]: r["admitted"] for r in got.collect()}
    for user in range(5):
        tokens, last = 2.0, None
        for r in batch.where(F.col("user_id") == user).orderBy("ts").collect():
            now = r["ts"].timestamp()
            tokens = min(2.0, tokens + (now - last) / 600) if last is not None else tokens
            last = now
            assert admitted[r["event_id"]] is (tokens >= 1)
            tokens -= tokens >= 1


def test_crawl(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert sorted(map(tuple, crawl.bfs(seeds, e, 5).collect())) == [(1, 0), (2, 1), (3, 1)]
    c = spark.createDataFrame([("a", "k1", 1.0, 1), ("b", "k1", 0.0, 2), ("c", "k2", 0.5, 3), ("d", "k3", 0.1, 4)], "url string, key string, priority double, seq long")
    seen = spark.createDataFrame([("k3",)], "key string")
    assert [r["url"] for r in crawl.frontier_order(c, seen).collect()] == ["b", "c"]


@pytest.mark.parametrize(("load", "keys"), [(64, 9), (1, 45), (0, 495)])
def test_near_classes_are_exact(spark, monkeypatch, load, keys):
    """Components against brute force for keys of two to four bands; a hot key cut into cells; equal fingerprints; a chain of links."""
    import random

    monkeypatch.setattr(hamming, "LOAD", load)
    monkeypatch.setattr(hamming, "CELL", 16)
    r = random.Random(load)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 9))) & (1 << 64) - 1 for b in base for _ in range(4)]
    fps += [(1 << 6 * k) - 1 for k in range(10)] + [0xFF00 ^ (1 << r.randrange(64)) for _ in range(120)] + fps[:5]
    assert len(hamming.masks(8, len(set(fps)))) == keys
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {x["doc_id"]: (x["rep"], x["component"]) for x in dedup.near_classes(spark.createDataFrame(list(zip(range(len(fps)), signed)), "doc_id long, fp long")).collect()}
    assert got == {k: (fps.index(f), root[k]) for k, f in enumerate(fps)}


def test_connected_fingerprints_are_not_compared_again(monkeypatch):
    """A cell of 400 rows of one component and one row of another one: 400 comparisons, not 80200."""
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(hamming.np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    cell = pd.DataFrame({"key": 1, "i": 0, "j": 0, "label": [7] * 400 + [9], "fp": [*range(400), -1]})
    assert [len(x) for x in hamming._compare(8)(iter([cell]))] == [0]
    assert sum(compared) == 400


def test_large_tables_take_few_keys_and_miss_no_link():
    """Millions of fingerprints: 67 keys each, one of which any two within eight bits share; masks would take 165."""
    import random

    r = random.Random(3)
    every = hamming.keys(8, 1 << 22)
    assert len(hamming.masks(8, 1 << 22)) == 165 and sum(len(flips) for _, flips in every) == 67
    made = lambda f: {(m, (f & m ^ b) % (1 << 64)) for m, flips in every for b in flips}
    for _ in range(500):
        a = r.getrandbits(64)
        b = a ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 8)))
        assert made(a) & made(b)


def test_links_of_a_dense_cell_are_reduced_while_it_is_compared(monkeypatch):
    """600 rows of as many components, all within eight bits of each other: 179700 links, 599 come out, and few are held at a time."""
    held, forest = [], hamming.forest
    monkeypatch.setattr(hamming, "WAIT", 1000)
    monkeypatch.setattr(hamming, "forest", lambda a, b: held.append(len(a)) or forest(a, b))
    near = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))][:600]
    cell = pd.DataFrame({"key": 1, "i": 0, "j": 0, "label": range(600), "fp": near})
    (out,) = hamming._compare(8)(iter([cell]))
    assert len(out) == 599 and max(held) <= 1600
    assert set(forest(out["a"].to_numpy(), out["b"].to_numpy())[1]) == {0}


def test_neighbours_connect_a_dense_region(spark):
    """Of one group all are connected before any keys are made, and none of different groups."""
    prints = spark.createDataFrame([(g, 1000 * k + i, i) for k, g in enumerate("ab") for i in range(200)], "g string, label long, fp long").repartition(4)
    found = {tuple(x) for x in hamming.components(hamming.neighbours(prints, 8)).collect()}
    assert found == {(1000 * k + i, 1000 * k) for k in range(2) for i in range(200)}


def test_fingerprints_match_the_twin(spark):
    from weftline.operators import merge_fold

    texts = ["the quick, brown fox!", "", "a", "word " * 300_000 + "fox", "don't stop stop", "é ü", "x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["fp"] & (1 << 64) - 1 for x in dedup.simhash(d).collect()}
    assert got == {k: merge_fold.simhash(t) for k, t in enumerate(texts)}


def test_asof_and_ranges(spark):
    a = spark.createDataFrame([("x", 5, 1), ("x", 9, 2), ("y", 1, 3), (None, 9, 4), ("x", None, 5)], "k string, t long, id long")
    b = spark.createDataFrame([("x", 5, "p"), ("x", 7, "q"), ("y", 2, "r"), (None, 1, "s"), ("x", None, "u"), ("y", None, "w")], "k string, t long, v string")
    got = {r["id"]: r["v"] for r in relational.asof(a, b, "k", "t", ["v"]).collect()}
    assert got == {1: "p", 2: "q", 3: None, 4: None, 5: None}
    p = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (35.0,)], "x double")
    r = spark.createDataFrame([("a", 0.0, 10.0), ("b", 10.0, 40.0)], "n string, lo double, hi double")
    assert sorted((x["n"], x["x"]) for x in relational.bucketed_range(p, r, "x", "lo", "hi", 7.0).collect()) == [("a", 0.0), ("a", 9.9), ("b", 10.0), ("b", 35.0)]


def test_profiles(spark):
    o = spark.createDataFrame([("d", "a", True, 100.0), ("d", "a", True, 200.0), ("d", "b", False, 90000.0), ("d", "b", False, 90000.0), ("d", "b", False, 90000.0)], "domain string, engine_id string, ok boolean, elapsed_ms double")
    s = profile.engine_scores(o)
    assert profile.best_engine(s).first()["best_engine"] == "a" and [r["engine_id"] for r in profile.engines_to_skip(s).collect()] == ["b"]
    assert s.where("engine_id = 'a'").first()["avg_ms"] == 150.0
    assert profile.recommended_timeout(o).first()["timeout_s"] == 120.0


def test_reports(spark, tmp_path):
    pages = spark.createDataFrame([("http://e.com/1", '<title>T <x></title><h1>Main Heading</h1><a href="/a&b">L</a><img src="/i.png">')], "url string, html string")
    m = pipeline.merge(pipeline.engine_results(pages))
    sinks.write_csv(m, f"file://{tmp_path}/csv")
    assert {r["type"] for r in spark.read.csv(f"file://{tmp_path}/csv", header=True).collect()} == {"link", "image", "heading"}
    sinks.write_json(m, f"file://{tmp_path}/json")
    sinks.write_sheets(m, f"file://{tmp_path}/sheets")
    assert spark.read.parquet(f"file://{tmp_path}/sheets/links").first()["is_external"] is False
    e = spark.createDataFrame([("a&b", "c<d")], "src string, dst string")
    text = "\n".join(r["line"] for r in sinks.graphml_lines(e).orderBy("ord").collect())
    assert len(ET.fromstring(text.split("?>", 1)[1].strip())) == 1
    page = sinks.html_reports(m).first()["html"]
    assert "<x>" not in page and "/a&amp;b" in page
    sinks.write_raw(pipeline.engine_results(pages), f"file://{tmp_path}/raw")
    sinks.write_audit(pipeline.decisions(m), f"file://{tmp_path}/audit")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    d = files.describe(files.read_csv(spark, f"file://{tmp_path}/a.csv")).first()
    assert d["row_count"] == 2 and d["columns"] == ["x", "y"]
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert files.read_json(spark, f"file://{tmp_path}/a.json").count() == 2
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A</title></item><item><title>B</title></item></channel></rss>")
    assert files.read_xml(spark, f"file://{tmp_path}/a.xml", "item").count() == 2
    one = spark.range(1).select(files.feed_items(F.lit('<feed><entry><title>T</title><link rel="alternate" href="http://x/1"/></entry></feed>')).alias("i")).first()["i"]
    assert [(x["title"], x["link"]) for x in one] == [("T", "http://x/1")]
