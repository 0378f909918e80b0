"""Domain profiles from engine outcomes: outcomes(domain, engine_id, ok boolean, elapsed_ms double, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def engine_scores(outcomes: DataFrame) -> DataFrame:
    ok = F.count_if("ok")
    s = outcomes.groupBy("domain", "engine_id").agg(ok.alias("ok"), F.count_if(~F.col("ok")).alias("fail"), F.avg("elapsed_ms").alias("avg_ms"))
    return s.withColumn("rate", F.col("ok") / (F.col("ok") + F.col("fail")))


def best_engine(scores: DataFrame) -> DataFrame:
    """Highest success rate, then first name."""
    return scores.groupBy("domain").agg(F.min(F.struct((-F.col("rate")).alias("r"), "engine_id")).alias("b")).select("domain", F.col("b.engine_id").alias("best_engine"), (-F.col("b.r")).alias("rate"))


def engines_to_skip(scores: DataFrame) -> DataFrame:
    total = F.col("ok") + F.col("fail")
    return scores.where((total >= C.MIN_OBSERVATIONS) & (F.col("fail") / total >= C.FAILURE_RATIO)).select("domain", "engine_id")


def recommended_timeout(outcomes: DataFrame) -> DataFrame:
    """Three times the mean load time in seconds, within 10 and 120; 30 without history."""
    s = outcomes.groupBy("domain").agg(F.avg("elapsed_ms").alias("avg_load_ms"))
    return s.withColumn("timeout_s", F.when(F.col("avg_load_ms") <= 0, 30.0).otherwise(F.round(F.greatest(F.lit(10.0), F.least(F.col("avg_load_ms") * 3 / 1000, F.lit(120.0))), 1)))


def preferred(scores: DataFrame) -> DataFrame:
    """Rank of each engine in its domain by success rate, for domains with enough runs. A domain has few engines, so a window is small."""
    runs = scores.groupBy("domain").agg(F.sum(F.col("ok") + F.col("fail")).alias("runs")).where(F.col("runs") >= C.MIN_OBSERVATIONS)
    ranked = scores.join(runs, "domain").withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("rate"), "engine_id")).cast("long"))
    return ranked.select("domain", "engine_id", "rank")


def field_accuracy(observations: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(domain, engine_id, field, ok, fail) from boolean columns ``fields`` (name -> column)."""
    rows = observations.select("domain", "engine_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("ok")) for n, c in fields.items()])).alias("o"))
    return rows.groupBy("domain", "engine_id", F.col("o.field").alias("field")).agg(F.count_if("o.ok").alias("ok"), F.count_if(~F.col("o.ok")).alias("fail"))


def best_for_field(accuracy: DataFrame) -> DataFrame:
    """Best engine a domain and field with two observations or more and a positive rate."""
    a = accuracy.withColumn("n", F.col("ok") + F.col("fail")).where("n >= 2 AND ok > 0").withColumn("rate", F.col("ok") / F.col("n"))
    return a.groupBy("domain", "field").agg(F.min(F.struct((-F.col("rate")).alias("r"), "engine_id")).alias("b")).select("domain", "field", F.col("b.engine_id").alias("engine_id"))


def miss_streaks(hits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """hits(key, hit boolean, ...) with hit_count so far, miss_streak since the last hit, and whether the selector is dead."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    h = hits.withColumn("hit_count", F.count_if("hit").over(w))
    inside = Window.partitionBy(key, "hit_count").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("miss_streak", F.count_if(~F.col("hit")).over(inside))
    return h.withColumn("dead", F.col("miss_streak") >= C.DEAD_SELECTOR_MISSES)


def circuit_open(outcomes: DataFrame) -> DataFrame:
    s = outcomes.groupBy("domain").agg(F.count("*").alias("n"), F.avg((~F.col("ok")).cast("int")).alias("failed"))
    return s.where((F.col("n") >= C.MIN_OBSERVATIONS) & (F.col("failed") >= C.FAILURE_RATIO))


def latency_histogram(outcomes: DataFrame, seconds: str) -> DataFrame:
    """Cumulative counts at the fixed latency bounds, long form (engine_id, le, n)."""
    bounds = F.array(*[F.lit(b) for b in C.LATENCY_BUCKETS])
    rows = outcomes.groupBy("engine_id").agg(*[F.count_if(F.col(seconds) <= b).alias(f"b{k}") for k, b in enumerate(C.LATENCY_BUCKETS)])
    counts = F.array(*[F.col(f"b{k}") for k in range(len(C.LATENCY_BUCKETS))])
    return rows.select("engine_id", F.explode(F.arrays_zip(bounds.alias("le"), counts.alias("n"))).alias("z")).select("engine_id", "z.le", "z.n")


def byte_budget(fetches: DataFrame, job: str, order: str, size: str, budget: int) -> DataFrame:
    """fetches with the running byte total of their job and whether it is still within the budget."""
    w = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return fetches.withColumn("total", F.sum(size).over(w)).withColumn("within", F.col("total") <= budget)
