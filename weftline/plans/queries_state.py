"""Queries on tables and streams that keep state: queues, progress, throttles, upserts, crawls that resume, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import session
from ..operators import crawl, payloads, tables
from ..streaming import events as ev
from ..streaming import keyed
from . import queries_pages as qp
from . import queries_records as qr
from .registry import query, table

_DELAY_S = 7200
_WM = f"w AS (SELECT (epoch_ms(max(ts)) - {_DELAY_S * 1000}) * 1000 AS wm FROM events)"


def _rows(spark, d) -> DataFrame:
    """The events as a stream of (key, ts, seq, tag), a key a user."""
    return ev.read_stream(spark, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("tag"))


# ---------------------------------------------------------------- keyed streams with timers
@query(
    f"""WITH {_WM}, e AS (SELECT user_id AS key, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events, w WHERE epoch_us(ts) <= wm),
r AS (SELECT *, sum((gap IS NULL OR gap >= {C.QUEUE_TTL_S * 1_000_000})::INT) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT key, min(ts) AS created, max(ts) AS last, count(*) AS n, max(ts) + INTERVAL {C.QUEUE_TTL_S} SECOND AS evicted FROM r, w GROUP BY key, run HAVING epoch_us(max(ts)) + {C.QUEUE_TTL_S * 1_000_000} <= any_value(wm)"""
)
def queue_evictions(spark, d):
    """Queues that had no event for their time to live, as the stream's watermark passes it."""
    return ev.run_append(keyed.evictions(_rows(spark, d), C.QUEUE_TTL_S, f"{_DELAY_S} seconds"), "evictions", conf=keyed.STORE)


_GAP_S = 21600


@query(
    f"""WITH {_WM}, e AS (SELECT user_id AS key, ts, event_id AS seq, event_type AS tag, wm FROM events, w WHERE epoch_us(ts) <= wm),
n AS (SELECT *, coalesce(epoch_us(lead(ts) OVER (PARTITION BY key ORDER BY ts, seq)), wm + 1) AS stop FROM e),
b AS (SELECT key, ts, unnest(range(1, (stop - 1 - epoch_us(ts)) // {_GAP_S * 1_000_000} + 1)) AS k FROM n WHERE tag <> 'purchase')
SELECT key, ts, seq, CASE WHEN tag = 'purchase' THEN 'end' ELSE 'event' END AS kind, tag FROM n UNION ALL SELECT key, ts + k * INTERVAL {_GAP_S} SECOND, NULL, 'heartbeat', NULL FROM b"""
)
def progress_feed(spark, d):
    """Events of every job with heartbeats between them, until a purchase ends it."""
    return ev.run_append(keyed.progress(_rows(spark, d), _GAP_S, ("purchase",), f"{_DELAY_S} seconds"), "feed", conf=keyed.STORE)


_HOUR_US = 3_600_000_000


def _starts(domain: str, delay: str, rest: str = "") -> str:
    i = f"row_number() OVER (PARTITION BY {domain} ORDER BY ts, event_id) - 1"
    return f"""f AS (SELECT *, {domain} AS domain, {delay} AS delay, {i} AS i FROM events {rest}),
s AS (SELECT *, max(epoch_us(ts) - i * delay) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + i * delay AS us FROM f)"""


@query(f"WITH {_starts('user_id % 40', f'(1 + user_id % 4) * {_HOUR_US}')} SELECT domain, event_id AS seq, ts, make_timestamp(us::BIGINT) AS start FROM s")
def crawl_starts(spark, d):
    """When each fetch may start if its domain wants one to four hours between fetches."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("domain"), "ts", F.col("event_id").alias("seq"), ((F.col("user_id") % 4 + 1) * _HOUR_US).alias("delay"))
    return crawl.earliest_starts(e, "delay").select("domain", "seq", "ts", "start")


@query(f"WITH {_WM}, {_starts('user_id', f'{_HOUR_US}', ', w WHERE epoch_us(ts) <= wm')} SELECT user_id AS key, event_id AS seq, ts, make_timestamp(us::BIGINT) AS start FROM s")
def stream_starts(spark, d):
    """As ``crawl_starts`` for a stream, an hour apart for each user."""
    return ev.run_append(keyed.throttled(_rows(spark, d), _HOUR_US, f"{_DELAY_S} seconds"), "starts", conf=keyed.STORE)


# ---------------------------------------------------------------- stored tables
_JOB = "CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END"
_UPDATE = {"ok": "old.ok + new.ok", "fail": "old.fail + new.fail", "run_count": "old.run_count + 1", "failure_rate": "new.failure_rate", "last_event": "greatest(old.last_event, new.last_event)"}


def job_outcomes(spark, d, job: int) -> DataFrame:
    """A job's outcomes by domain: a third of the month."""
    e = table(spark, d, "events").where(F.expr(_JOB) == job)
    ok, fail = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type") == "error")
    s = e.groupBy((F.col("user_id") % 40).alias("domain")).agg(ok.alias("ok"), fail.alias("fail"), F.max("event_id").alias("last_event"))
    return s.select("domain", "ok", "fail", F.lit(1).cast("long").alias("run_count"), (F.col("fail") / (F.col("ok") + F.col("fail"))).alias("failure_rate"), "last_event")


@query(
    f"""WITH j AS (SELECT user_id % 40 AS domain, {_JOB} AS job, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS fail, max(event_id) AS last_event FROM events GROUP BY ALL)
SELECT domain, sum(ok)::BIGINT AS ok, sum(fail)::BIGINT AS fail, count(*) AS run_count, arg_max(fail / (ok + fail), job) AS failure_rate, max(last_event) AS last_event FROM j GROUP BY domain"""
)
def profile_upsert(spark, d):
    """Domain profiles after three jobs, each an upsert into the stored table."""
    profiles = tables.KeyedTable(spark, session.scratch(spark, "profiles"), ["domain"], 16)
    for job in (1, 2, 3):
        profiles.upsert(job_outcomes(spark, d, job), _UPDATE)
    return profiles.read()


@query("WITH h AS (SELECT o_custkey AS key, o_orderkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders) SELECT * FROM h")
def history_stored(spark, d):
    """The history as appended to a stored table year by year, versions numbered on."""
    return stored_history(spark, d).read()


def stored_history(spark, d) -> tables.LogTable:
    t = tables.LogTable(spark, session.scratch(spark, "history"), "key", ["version"], 16)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    for years in ((0, 1994), (1995, 1996), (1997, 9999)):
        t.append_versions(o.where(F.year("seq.o_orderdate").between(*years)), "seq")
    return t


@query("WITH h AS (SELECT o_custkey AS key, o_orderkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders), k AS (SELECT min(o_custkey) AS key FROM orders) SELECT h.* FROM h JOIN k USING (key) ORDER BY version DESC LIMIT 5 OFFSET 1")
def history_of_key(spark, d):
    """A page of one key's versions, read from its own bucket."""
    t = stored_history(spark, d)
    return t.page(table(spark, d, "orders").agg(F.min("o_custkey").alias("k")).first()["k"], 5, 1).select("key", "id", "price", "version")


@query(f"WITH {qr._VOTE}, c AS (SELECT url, field, winner, agreement, agreement < 1 AS conflict FROM vote), k AS (SELECT min(url) AS a, max(url) AS b FROM pages) SELECT c.* FROM c, k WHERE c.conflict AND (url = a OR url = b)")
def audit_conflicts(spark, d):
    """The conflicts among the stored decisions of two pages."""
    t = tables.LogTable(spark, session.scratch(spark, "audit"), "url", ["field"], 16)
    t.append(qr.vote_exact(spark, d).withColumn("conflict", F.col("agreement") < 1))
    k = table(spark, d, "pages").agg(F.min("url").alias("a"), F.max("url").alias("b")).first()
    return t.of(k["a"], k["b"]).where("conflict").select("url", "field", "winner", "agreement", "conflict")


@query(qp._BFS)
def bfs_resumed(spark, d):
    """As ``bfs_reachability``, by a crawl that pauses after two levels and is resumed from its stored levels."""
    seeds, edges = qp.bfs_input(spark, d)
    path = session.scratch(spark, "crawl")
    crawl.resumable_bfs(seeds, edges, 10, path, levels=2)
    return crawl.resumable_bfs(seeds, edges, 10, path)


@query("WITH v AS (SELECT DISTINCT user_id || '/' || event_type AS key FROM events WHERE value > 150), c AS (SELECT user_id || '/' || event_type || '/' || (event_id % 3) AS url, user_id || '/' || event_type AS key, event_id FROM events) SELECT url, key, event_id FROM c WHERE key NOT IN (SELECT key FROM v)")
def not_visited(spark, d):
    """Candidates whose key was never visited: every candidate row, by a Bloom filter and an exact join of its positives."""
    from ..operators import membership

    key = F.concat_ws("/", "user_id", "event_type")
    e = table(spark, d, "events")
    c = e.select(F.concat_ws("/", "user_id", "event_type", (F.col("event_id") % 3).cast("string")).alias("url"), key.alias("key"), "event_id")
    return membership.not_in(c, e.where("value > 150").select(key.alias("key")).distinct(), "key")


# ---------------------------------------------------------------- observed payloads
# an event as an observed payload: nested, with an array of mixed elements; every eleventh is cut off
_NESTED = """'{"id": ' || event_id || ', "user": {"id": ' || user_id || ', "kind": "' || event_type || '"}, "items": [' || props || ', {"v": ' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'true' ELSE '"x"' END || '}, ' || (event_id % 7) || ']' || CASE WHEN event_id % 2 = 0 THEN ', "flag": false' ELSE '' END || '}'"""
_CUT = f"CASE WHEN event_id % 11 = 5 THEN left({_NESTED}, 20 + (event_id % 13)::INT) ELSE {_NESTED} END"


def observed(spark, d) -> DataFrame:
    return payloads.parse(table(spark, d, "events").select("event_id", F.expr(_CUT.replace("::INT", "")).alias("body")), "body")


@query(
    f"""WITH p AS (SELECT {_CUT} AS body FROM events), j AS (SELECT t.fullkey, t.type FROM p, json_tree(p.body) t WHERE json_valid(p.body))
SELECT regexp_replace(fullkey, '\\[\\d+\\]', '[*]', 'g') AS path, CASE type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE type END AS type, count(*) AS n FROM j GROUP BY ALL"""
)
def payload_paths(spark, d):
    """How often each path of the payloads holds a value of each type."""
    return payloads.paths(observed(spark, d))


_COLUMNS = {"user_id": ("$.user.id", "bigint"), "kind": ("$.user.kind", "string"), "k": ("$.items[0].k", "bigint"), "v": ("$.items[1].v", "string"), "flag": ("$.flag", "boolean"), "absent": ("$.user.name", "string")}


@query(
    f"""WITH p AS (SELECT event_id, {_CUT} AS body FROM events), j AS (SELECT event_id, NOT json_valid(body) AS malformed, CASE WHEN json_valid(body) THEN body END AS b FROM p)
SELECT event_id, malformed, (b->>'$.user.id')::BIGINT AS user_id, b->>'$.user.kind' AS kind, (b->>'$.items[0].k')::BIGINT AS k, b->>'$.items[1].v' AS v, (b->>'$.flag')::BOOLEAN AS flag, b->>'$.user.name' AS absent FROM j"""
)
def payload_columns(spark, d):
    """Paths of the payloads as columns; malformed payloads are told apart."""
    return payloads.shred(observed(spark, d), _COLUMNS).select("event_id", "malformed", *_COLUMNS)


# ---------------------------------------------------------------- metrics
_LE = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{k}" for k, b in enumerate(C.LATENCY_BUCKETS))


@query(f"SELECT count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS seconds_sum, count(value) AS seconds_count, max(value) AS seconds_max, {_LE} FROM events")
def observed_metrics(spark, d):
    """Measures taken by an observation while a profile is computed: one pass over the rows."""
    from ..operators import metrics

    e = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed_s"))
    rows, o = metrics.observed(e)
    rows.groupBy("user_id").agg(F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([o.get]).withColumn("seconds_sum", F.round("seconds_sum", 4))
