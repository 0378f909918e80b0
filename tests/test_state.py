"""Keyed streams with timers, stored tables, crawls that resume, membership filters and payloads, against plain versions."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline import session
from weftline.operators import crawl, membership, payloads, tables
from weftline.streaming import events as ev
from weftline.streaming import keyed

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture()
def folder(spark, tmp_path):
    return str(tmp_path)


def stream_of(spark, folder, batches):
    """Rows (key, seconds, seq, tag) as a stream of one file a batch."""
    schema = "key long, ts timestamp, seq long, tag string"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(a, at(s), q, t) for a, s, q, t in rows], schema).coalesce(1).write.parquet(f"{folder}/in/b={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def sample(seed=1, n=400, keys=5, span=40_000):
    r = random.Random(seed)
    rows = [(r.randrange(keys), r.randrange(span), k, r.choice(["view", "view", "click", "done"])) for k in range(n)]
    return sorted(rows, key=lambda x: x[1] + r.randrange(600))  # out of order by less than the delay


def cut(rows, k):
    return [rows[i * len(rows) // k : (i + 1) * len(rows) // k] for i in range(k)]


def watermark(rows, delay):
    return max(x[1] for x in rows) - delay


def secs(t):
    return (t - T0).total_seconds()


# ---------------------------------------------------------------- streams
@pytest.mark.parametrize("batches", [1, 4])
def test_evictions(spark, folder, batches):
    rows = sample()
    out = ev.run_append(keyed.evictions(stream_of(spark, folder, cut(rows, batches)), 900, "700 seconds"), "x", f"{folder}/run", keyed.STORE)
    end, want, left = watermark(rows, 700), set(), set()
    for key in range(5):
        run = []
        for s in [*sorted(s for k, s, _, _ in rows if k == key and s <= end), None]:
            if run and (s is None or s - run[-1] >= 900):
                if run[-1] + 900 <= end:
                    want.add((key, run[0], run[-1], len(run), run[-1] + 900))
                else:
                    left.add((key, run[0], run[-1], len(run)))
                run = []
            run.append(s)
    got = [(r["key"], secs(r["created"]), secs(r["last"]), r["n"], secs(r["evicted"])) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    state = spark.read.format("statestore").option("stateVarName", "now").load(f"{folder}/run/checkpoint")
    kept = {(r["key"]["key"], r["value"]["created"], r["value"]["last"], r["value"]["n"]) for r in state.collect()}
    micros = lambda s: int((at(s) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert kept == {(k, micros(a), micros(b), n) for k, a, b, n in left}  # evicted queues have no state


@pytest.mark.parametrize("batches", [1, 5])
def test_progress(spark, folder, batches):
    rows = sample(seed=2)
    out = ev.run_append(keyed.progress(stream_of(spark, folder, cut(rows, batches)), 300, ("done",), "700 seconds"), "x", f"{folder}/run", keyed.STORE)
    end, want = watermark(rows, 700), []
    for key in range(5):
        own = sorted((s, q, t) for k, s, q, t in rows if k == key and s <= end)
        for (s, q, t), after in zip(own, [*own[1:], (end + 1, 0, "")]):
            want.append((key, s, q, "end" if t == "done" else "event", t))
            beat = s + 300
            while t != "done" and beat < after[0]:
                want.append((key, beat, None, "heartbeat", None))
                beat += 300
    got = [(r["key"], secs(r["ts"]), r["seq"], r["kind"], r["tag"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((k, float(s), *x) for k, s, *x in want), key=repr)


def test_progress_resumes(spark, folder):
    """A stream that is stopped and started again puts out what one run would have."""
    rows = sample(seed=3)
    halves = cut(rows, 2)
    one = stream_of(spark, f"{folder}/a", [rows[: len(rows) // 2], rows[len(rows) // 2 :]])
    whole = ev.run_append(keyed.progress(one, 300, ("done",), "700 seconds"), "x", None, keyed.STORE)
    first = stream_of(spark, f"{folder}/b", halves[:1])
    ev.run_append(keyed.progress(first, 300, ("done",), "700 seconds"), "x", f"{folder}/run", keyed.STORE)
    spark.createDataFrame([(a, at(s), q, t) for a, s, q, t in halves[1]], "key long, ts timestamp, seq long, tag string").coalesce(1).write.parquet(f"{folder}/b/in/b=1")
    again = ev.run_append(keyed.progress(first, 300, ("done",), "700 seconds"), "x", f"{folder}/run", keyed.STORE)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_rows_are_held_by_pieces(spark, folder):
    """A key's rows that wait are one entry of the state store a batch, not one each."""
    rows = sample(seed=6, span=650)  # none that the watermark passes
    ev.run_append(keyed.evictions(stream_of(spark, folder, cut(rows, 2)), 900, "700 seconds"), "x", f"{folder}/run", keyed.STORE)
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{folder}/run/checkpoint")
    assert 5 <= held.count() <= 2 * 5


def test_pieces_of_a_long_wait(spark, folder):
    """More rows than a piece has, some without seq or tag, which wait over several batches."""
    feed = keyed.Progress(300_000_000, ("done",))
    feed.piece_rows = 7
    rows = [(k, s, None if q % 9 == 4 else q, None if q % 5 == 1 else t) for k, s, q, t in sample(seed=7, keys=2, span=2_000)]
    stream = keyed.in_order(stream_of(spark, folder, cut(rows, 6)), feed, "at long, seq long, kind string, tag string", "700 seconds")
    out = ev.run_append(stream.withColumn("ts", F.timestamp_micros("at")), "x", f"{folder}/run", keyed.STORE)
    end = watermark(rows, 700)
    got = [(r["key"], secs(r["ts"]), r["seq"], r["tag"]) for r in out.where("kind <> 'heartbeat'").collect()]
    assert sorted(got, key=repr) == sorted([(k, float(s), q, t) for k, s, q, t in rows if s <= end], key=repr)


def plain_starts(rows, delay):
    out, ready = {}, {}
    for key, s, q in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        out[q] = max(s, ready.get(key, s))
        ready[key] = out[q] + delay[key]
    return out


def test_stream_and_batch_starts_agree(spark, folder):
    rows = sample(seed=4)
    stream = stream_of(spark, folder, cut(rows, 4))
    end = watermark(rows, 700)
    want = plain_starts([(k, s, q) for k, s, q, _ in rows if s <= end], dict.fromkeys(range(5), 120))
    out = ev.run_append(keyed.throttled(stream, 120_000_000, "700 seconds"), "x", f"{folder}/run", keyed.STORE)
    assert {r["seq"]: secs(r["start"]) for r in out.collect()} == want
    batch = spark.createDataFrame([(k, at(s), q, 120_000_000) for k, s, q, _ in rows if s <= end], "domain long, ts timestamp, seq long, d long")
    assert {r["seq"]: secs(r["start"]) for r in crawl.earliest_starts(batch, "d").collect()} == want


def test_starts_of_a_hot_domain(spark):
    r = random.Random(5)
    rows = [(0 if r.random() < 0.7 else r.randrange(1, 6), r.randrange(3000), k) for k in range(4000)]
    delay = {k: k + 1 for k in range(6)}
    df = spark.createDataFrame([(k, at(s), q, delay[k] * 1_000_000) for k, s, q in rows], "domain long, ts timestamp, seq long, d long").repartition(6)
    out = crawl.earliest_starts(df, "d")
    assert {x["seq"]: secs(x["start"]) for x in out.collect()} == plain_starts(rows, delay)
    empty = crawl.earliest_starts(df.where("false"), "d")
    assert empty.columns == ["domain", "ts", "seq", "d", "start"] and empty.collect() == []


# ---------------------------------------------------------------- stored tables
def test_upsert_is_that_of_sql(spark, folder):
    t = tables.KeyedTable(spark, f"{folder}/t", ["k"], 8)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT PRIMARY KEY, n BIGINT, last VARCHAR)")
    r = random.Random(6)
    for _ in range(5):
        rows = [(k, r.randrange(100), r.choice("abc")) for k in r.sample(range(60), 20)]
        t.upsert(spark.createDataFrame(rows, "k long, n long, last string"), {"n": "old.n + new.n", "last": "new.last"})
        con.executemany("INSERT INTO t VALUES (?, ?, ?) ON CONFLICT (k) DO UPDATE SET n = t.n + excluded.n, last = excluded.last", rows)
        assert sorted(map(tuple, t.read().collect())) == sorted(con.sql("FROM t").fetchall())
    k = con.sql("SELECT min(k) FROM t").fetchall()[0][0]
    assert [tuple(x) for x in t.get(k=k).collect()] == con.sql(f"FROM t WHERE k = {k}").fetchall()
    assert t.get(k=1000).collect() == []
    before = sorted(map(tuple, t.read().collect()))
    assert t.store.vacuum() > 0 and t.store.vacuum() == 0
    assert sorted(map(tuple, t.read().collect())) == before


def test_upsert_leaves_other_buckets_and_null_keys(spark, folder):
    t = tables.KeyedTable(spark, f"{folder}/t", ["k"], 16)
    t.upsert(spark.createDataFrame([(k, 0) for k in range(200)] + [(None, 0)], "k long, n long"))
    before = t.store.files()
    t.upsert(spark.createDataFrame([(7, 1), (None, 1), (1000, 1)], "k long, n long"))
    after = t.store.files()
    changed = [b for b in after if after[b] != before.get(b)]
    assert 1 <= len(changed) <= 3
    assert {(x["k"], x["n"]) for x in t.read().where("n = 1").collect()} == {(7, 1), (None, 1), (1000, 1)} and t.read().count() == 202
    assert t.upsert(spark.createDataFrame([], "k long, n long")) == 2
    with pytest.raises(ValueError, match="one key"):
        t.upsert(spark.createDataFrame([(7, 1), (7, 2)], "k long, n long"))
    assert t.store.version() == 2


def test_a_crash_before_the_swap_changes_nothing(spark, folder, monkeypatch):
    t = tables.KeyedTable(spark, f"{folder}/t", ["k"], 4)
    t.upsert(spark.createDataFrame([(k, 0) for k in range(50)], "k long, n long"))
    before = sorted(map(tuple, t.read().collect()))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables.Snapshots, "_publish", crash)
        with pytest.raises(OSError):
            t.upsert(spark.createDataFrame([(k, 9) for k in range(80)], "k long, n long"))
    assert t.store.version() == 1 and sorted(map(tuple, t.read().collect())) == before
    t.upsert(spark.createDataFrame([(3, 5)], "k long, n long"))
    assert t.read().where("k = 3").first()["n"] == 5 and t.store.vacuum() >= 2


def test_two_writers_of_one_version(spark, folder):
    a = tables.Snapshots(spark, f"{folder}/t")
    a.commit({0: spark.range(3)})
    m = a._manifest()
    a.commit({0: spark.range(4)})
    with pytest.raises(RuntimeError, match="another writer"):
        a._swap(1, m, {}, None, False)
    assert a.read().count() == 4


# ---------------------------------------------------------------- crawls
def graph(spark, seed=7):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(200)] + [(500, 501)]
    return spark.createDataFrame([(0,)], "node long"), spark.createDataFrame(edges, "src long, dst long"), edges


def plain_bfs(edges, depth):
    seen, front = {0: 0}, [0]
    for d in range(1, depth + 1):
        front = sorted({b for a, b in edges if a in set(front)} - seen.keys())
        seen |= dict.fromkeys(front, d)
    return seen


def test_a_crawl_resumes_behind_its_last_level(spark, folder, monkeypatch):
    seeds, edges, plain = graph(spark)
    path, commit, calls = f"{folder}/crawl", tables.Snapshots.commit, []

    def dies(self, buckets, note=None, append=False):
        calls.append(sorted(buckets))
        if len(calls) == 4:
            raise OSError("lost")
        return commit(self, buckets, note, append)

    with monkeypatch.context() as m:
        m.setattr(tables.Snapshots, "commit", dies)
        with pytest.raises(OSError):
            crawl.resumable_bfs(seeds, edges, 12, path)
    assert tables.Snapshots(spark, path).buckets() == [0, 1, 2]
    early = crawl.resumable_bfs(seeds, edges, 12, path, levels=0)
    assert {r["node"]: r["depth"] for r in early.collect()} == plain_bfs(plain, 2)
    with monkeypatch.context() as m:
        m.setattr(tables.Snapshots, "commit", lambda self, b, n=None, a=False: calls.append(sorted(b)) or commit(self, b, n, a))
        out = crawl.resumable_bfs(seeds, edges, 12, path)
    assert {r["node"]: r["depth"] for r in out.collect()} == plain_bfs(plain, 12)
    assert calls[4] == [3]  # levels 0 to 2 were not done again
    assert tables.Snapshots(spark, path).note()["status"] == "complete"
    assert sorted(map(tuple, crawl.resumable_bfs(seeds, edges, 12, path).collect())) == sorted(map(tuple, out.collect()))


def test_bfs_agrees_with_the_resumable_one(spark, folder):
    seeds, edges, plain = graph(spark, 8)
    assert {r["node"]: r["depth"] for r in crawl.bfs(seeds, edges, 3).collect()} == plain_bfs(plain, 3)
    assert {r["node"]: r["depth"] for r in crawl.resumable_bfs(seeds, edges, 3, f"{folder}/c").collect()} == plain_bfs(plain, 3)


# ---------------------------------------------------------------- membership
def shuffled(df):
    """Rows that a finished query shuffled."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += p.metrics().get("shuffleRecordsWritten").get().value()
            todo += [p.children().apply(k) for k in range(p.children().size())]
    return total


def test_membership_shuffles_positives_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40_000).select(F.concat(F.lit("https://e.example/"), "id").alias("key"), "id")
        seen = spark.range(0, 40_000, 10).select(F.concat(F.lit("https://e.example/"), "id").alias("key"))
        out = membership.not_in(rows, seen, "key")
        assert sorted(r["id"] for r in out.collect()) == [k for k in range(40_000) if k % 10]
        by_filter = shuffled(out)
        plain = rows.join(seen, "key", "left_anti")
        plain.collect()
        assert 0 < by_filter < 0.35 * shuffled(plain)  # positives, the seen keys and the filter's words
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_membership_is_exact(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("", 4), ("b", 5)], "key string, n int")
    seen = spark.createDataFrame([("b",), ("b",), (None,), ("z",)], "key string")
    for limit in (membership.LIMIT, -1):
        assert sorted(r["n"] for r in membership.not_in(rows, seen, "key", limit).collect()) == [1, 2, 3, 4]
        assert membership.not_in(rows, seen.where("false"), "key", limit).count() == 5
        assert membership.not_in(rows.where("false"), seen, "key", limit).count() == 0
    n = 3000
    keys, other = spark.range(n).select(F.col("id").alias("key")), spark.range(n, 11 * n).select(F.col("id").alias("key"))
    words = membership.bloom(keys, "key", n)
    assert membership.split(keys, words, "key", n).where("NOT maybe").count() == 0
    assert membership.split(other, words, "key", n).where("maybe").count() < 0.05 * 10 * n


# ---------------------------------------------------------------- payloads
def test_payloads(spark):
    texts = ['{"a": {"b": 1}, "c": [1, {"d": "x"}, null]}', '{"a": {"b": "s"}}', "[true, 2.5]", '"s"', "{bad", "", None, "{}"]
    p = payloads.parse(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, body string"), "body")
    assert [r["id"] for r in p.where("malformed").orderBy("id").collect()] == [4, 5]
    got = {(r["path"], r["type"]): r["n"] for r in payloads.paths(p).collect()}
    assert got == {("$", "OBJECT"): 3, ("$", "ARRAY"): 1, ("$", "STRING"): 1, ("$.a", "OBJECT"): 2, ("$.a.b", "BIGINT"): 1, ("$.a.b", "STRING"): 1, ("$.c", "ARRAY"): 1, ("$.c[*]", "BIGINT"): 1, ("$.c[*]", "OBJECT"): 1, ("$.c[*]", "VOID"): 1, ("$.c[*].d", "STRING"): 1, ("$[*]", "BOOLEAN"): 1, ("$[*]", "DECIMAL"): 1}
    wide = payloads.shred(p, {"b": ("$.a.b", "bigint"), "d": ("$.c[1].d", "string")})
    assert [(r["id"], r["b"], r["d"]) for r in wide.where("b IS NOT NULL OR d IS NOT NULL").orderBy("id").collect()] == [(0, 1, "x")]
    assert payloads.frequent(payloads.paths(p), 1) == [("$", "STRING"), ("$.a.b", "BIGINT"), ("$.a.b", "STRING")]
    assert payloads.schema(p.where("id < 2")).first()["schema"].startswith("OBJECT<a: OBJECT<b: VARIANT>")


def test_scratch_folders_are_apart(spark):
    a, b = session.scratch(spark, "x"), session.scratch(spark, "x")
    assert a != b and a.startswith(session.shared_dir(spark))


# ---------------------------------------------------------------- stored logs, metrics
def test_point_reads_open_one_bucket(spark, folder):
    t = tables.LogTable(spark, f"{folder}/t", "url", ["version"], 16)
    urls = [f"https://e.example/{k}" for k in range(100)]
    for part in range(3):
        t.append_versions(spark.createDataFrame([(u, part * 10 + s, f"{part}{s}") for u in urls for s in range(2)], "url string, seq int, body string").repartition(3), "seq")
    assert t.store.version() == 3 and t.read().count() == 600
    one = t.of(urls[7])
    assert sorted((r["version"], r["body"]) for r in one.collect()) == [(1, "00"), (2, "01"), (3, "10"), (4, "11"), (5, "20"), (6, "21")]
    assert len(one.inputFiles()) == 3 < len(t.read().inputFiles()) / 8  # a file an append, of one bucket
    assert [r["version"] for r in t.page(urls[7], 2, 1).collect()] == [5, 4]
    assert t.compact(2) == 4 and len(t.of(urls[7]).inputFiles()) == 1
    assert t.read().count() == 600 and t.compact(2) == 4
    assert t.of("absent").collect() == []


def test_metrics_of_one_pass_are_those_of_an_aggregate(spark, folder):
    from weftline.operators import metrics

    r = random.Random(9)
    rows = [(r.random() < 0.8, r.random() * 40 if r.random() < 0.9 else None) for _ in range(500)]
    df = spark.createDataFrame(rows, "ok boolean, elapsed_s double")
    seen, o = metrics.observed(df)
    assert seen.where("ok").count() == sum(ok for ok, _ in rows)
    want = df.agg(*metrics.measures()).first().asDict()
    assert o.get == want
    text = metrics.exposition(o.get, {"jobs_active": 2})
    assert f"engine_runs_total {len(rows)}\n" in text and "# TYPE jobs_active gauge\njobs_active 2\n" in text
    df.repartition(3).write.parquet(f"{folder}/in")
    live = metrics.LiveMetrics("m")
    spark.streams.addListener(live)
    try:
        s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").observe("m", *metrics.measures())
        ev.run_append(s, "x", f"{folder}/run")
        for _ in range(100):
            if live.values().get("runs") == len(rows) and live.gauges().get("streams_active") == 0:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(live)
    got = live.values()
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()} and live.gauges()["streams_active"] == 0
