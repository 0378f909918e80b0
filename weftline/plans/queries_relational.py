"""Queries over the star schema and events: joins, sets, grouping, windows, sorting, time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational
from ..streaming import events as ev
from .registry import query, table


def t(spark, d, name):
    return table(spark, d, name)


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q_join_inner(spark, d):
    # aggregated by key before the join: nation's rows never meet the customers'
    per = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("b"))
    return per.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", F.round("b", 2).alias("balance"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_left_anti(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def q_left_semi(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT coalesce(c.k, s.k) AS nationkey, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def q_full_outer(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "full")


@query("WITH b(name, lo, hi) AS (VALUES ('low', 0.0::DOUBLE, 50000.0::DOUBLE), ('mid', 50000.0, 150000.0), ('high', 150000.0, 1000000.0)) SELECT name, count(*) AS orders FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi GROUP BY name")
def q_range_join(spark, d):
    b = spark.createDataFrame([("low", 0.0, 50000.0), ("mid", 50000.0, 150000.0), ("high", 150000.0, 1000000.0)], "name string, lo double, hi double")
    o = t(spark, d, "orders").select("o_totalprice")
    return relational.bucketed_range(o, b, "o_totalprice", "lo", "hi", 50000.0).groupBy("name").agg(F.count("*").alias("orders"))


_VIEWS = "(SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)"


@query(f"SELECT p.user_id, p.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN {_VIEWS} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def q_asof(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return relational.asof(left, right, "user_id", "ts", ["view_id"]).select("user_id", "event_id", "view_id")


@query("SELECT c_nationkey AS k, 'customer' AS side FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier")
def q_union(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side"))
    return c.union(t(spark, d, "supplier").select("s_nationkey", F.lit("supplier"))).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q_intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def q_except(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(t(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def q_grouping_sets(spark, d):
    li = t(spark, d, "lineitem")
    out = li.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], "l_returnflag", "l_linestatus")
    return out.agg(F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """SELECT o_orderkey, (sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS moving_cents,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quartile, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders"""
)
def q_window_frames(spark, d):
    by = Window.partitionBy("o_custkey")
    time = by.orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select(
        "o_orderkey",
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(time.rowsBetween(-2, 0)).alias("moving_cents"),
        F.rank().over(by.orderBy(F.desc("o_totalprice"))).cast("long").alias("price_rank"),
        F.ntile(4).over(by.orderBy("o_orderkey")).cast("long").alias("quartile"),
        F.first("o_orderkey").over(time).alias("first_order"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q_topk(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY l_returnflag")
def q_pivot(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().na.fill(0)


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def q_distinct_agg(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query()
def q_approx_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"""
)
def q_local_revenue(spark, d):
    nations = t(spark, d, "nation").join(t(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    c = t(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q_pricing_summary(spark, d):
    li = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("SELECT event_type, (props->>'k')::INT % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def q_json_props(spark, d):
    return t(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("bucket")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- event time
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return ev.tumbling(t(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 2))


@query(
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type FROM events)
SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL"""
)
def events_sliding(spark, d):
    return ev.sliding(t(spark, d, "events"), "1 hour", "30 minutes")


@query(
    """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS gap FROM events),
s AS (SELECT user_id, ts, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, s"""
)
def events_session(spark, d):
    return ev.sessions(t(spark, d, "events"), "30 minutes")


@query("SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL")
def events_dedup(spark, d):
    return ev.first_of(t(spark, d, "events"), ["user_id", "event_type"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL", name="stream_tumbling")
def stream_tumbling(spark, d):
    """The tumbling windows as a stream over the files of the table, run to its end."""
    s = ev.read_stream(spark, d)
    return ev.run_complete(ev.tumbling(s.withWatermark("ts", "1 hour"), "1 hour"), "tumbling").withColumn("total", F.round("total", 2))


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def progress_latest(spark, d):
    return ev.run_complete(ev.latest_status(ev.read_stream(spark, d)), "progress")


@query()
def token_bucket(spark, d):
    """Admission of each event under a token bucket a user (five tokens, one a minute), as a stateful stream."""
    return ev.run_append(ev.token_bucket(ev.read_stream(spark, d), capacity=5.0, per_second=1 / 60), "bucket")
