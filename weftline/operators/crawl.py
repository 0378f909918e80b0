"""Crawl graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from . import membership, tables


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): nodes within ``max_depth`` links of the seeds(node), at their least depth.

    One join a level against edges(src, dst); the levels are bounded by ``max_depth``, and each new
    frontier is checkpointed, so plans stay short and survive lost executors.
    """
    spark = seeds.sparkSession
    session.checkpoints(spark)
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def resumable_bfs(seeds: DataFrame, edges: DataFrame, max_depth: int, path: str, levels: int | None = None) -> DataFrame:
    """As ``bfs``, committed level by level to the table at ``path``: a call after a crash goes on behind the last commit.

    A level is one commit of its own bucket: its nodes are the frontier, those of all levels the visited ones. A
    finished crawl is read back as it is. ``levels``: most levels of this call, for crawls that pause.
    """
    spark = seeds.sparkSession
    store = tables.Snapshots(spark, path)
    if not store.version():
        store.commit({0: seeds.select("node").distinct().withColumn("depth", F.lit(0))}, {"status": "active"})
    done = 0
    while store.note()["status"] == "active" and (levels is None or done < levels):
        depth = max(store.buckets()) + 1
        if depth > max_depth:
            store.commit({}, {"status": "complete"})
            break
        frontier = store.read([depth - 1])
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = membership.not_in(reached, store.read(), "node").withColumn("depth", F.lit(depth))
        store.commit({depth: fresh}, {"status": "active"})
        if not store.read([depth]).limit(1).count():
            store.commit({}, {"status": "complete"})
        done += 1
    return store.read()


def frontier_order(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """candidates(url, key, priority, seq) not yet visited(key), the first of each key, with their order."""
    fresh = membership.not_in(candidates, visited, "key")
    first = fresh.groupBy("key").agg(F.min(F.struct("priority", "seq", "url")).alias("f")).select("key", "f.*")
    return first.orderBy("priority", "seq")


def earliest_starts(fetches: DataFrame, delay_us: str) -> DataFrame:
    """fetches(domain, ts, seq, ...) with ``start``: the earliest permitted start of each, in the order of (ts, seq) of its domain.

    A fetch starts at its time, but not before ``delay_us`` (a column of microseconds, one value a domain) behind
    the start before it. With i earlier fetches of the domain that is max(ts - i * delay) + i * delay, the maximum
    over the fetch and all before it: a prefix maximum, taken in two levels. Fetches are dealt out by ranges of
    (domain, ts, seq), so a large domain lies in many tasks; each task's share of a domain gives its count and its
    maximum, and a scan over these few rows tells what stands before each share.
    """
    session.checkpoints(fetches.sparkSession)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    dealt = fetches.repartitionByRange("domain", "ts", "seq").withColumn("share", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("domain", "share").orderBy("ts", "seq")
    own = dealt.withColumn("i", (F.row_number().over(inside) - 1).cast("long"))
    own = own.withColumn("lead", F.max(at - F.col("i") * F.col(delay_us)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    shares = dealt.groupBy("domain", "share").agg(F.count("*").alias("n"), F.max(delay_us).alias("delay"))
    shares = shares.join(own.groupBy("domain", "share").agg(F.max("lead").alias("most")), ["domain", "share"])
    earlier = Window.partitionBy("domain").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)  # a domain has as many rows as tasks at most
    shares = shares.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    shares = shares.withColumn("carried", F.max(F.col("most") - F.col("before") * F.col("delay")).over(earlier))
    both = own.join(shares.select("domain", "share", "before", "carried"), ["domain", "share"])
    shift = F.col("before") * F.col(delay_us)
    start = F.greatest(F.col("lead") - shift, F.col("carried")) + shift + F.col("i") * F.col(delay_us)  # greatest skips nulls
    return both.withColumn("start", F.timestamp_micros(start)).select(*fetches.columns, "start")


def crawl_gaps(fetches: DataFrame, delay_s: float) -> DataFrame:
    """fetches(domain, ts, ...) with ``gap_s`` to the domain's fetch before and whether it kept the delay."""
    before = F.lag("ts").over(Window.partitionBy("domain").orderBy("ts"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return fetches.withColumn("gap_s", F.round(gap / 1e6, 3)).withColumn("kept", F.coalesce(F.col("gap_s") >= delay_s, F.lit(True)))
