"""Jobs, sites and their bookkeeping: projections, merging back, listings, phases, bans, flags, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


# ---------------------------------------------------------------- documents
def fill_fallbacks(merged: DataFrame, found: dict[str, Column]) -> DataFrame:
    """Empty fields of ``merged`` refilled from ``found``; ``fallback_fields`` names those that were."""
    empty = {f: F.trim(F.coalesce(F.col(f), F.lit(""))) == "" for f in found}
    filled = {f: F.when(empty[f], F.coalesce(c, F.lit(""))).otherwise(F.col(f)) for f, c in found.items()}
    used = F.array_compact(F.array(*[F.when(empty[f] & (F.coalesce(found[f], F.lit("")) != ""), F.lit(f)) for f in found]))
    return merged.withColumns({**filled, "fallback_fields": used})


def page_results(merged: DataFrame) -> DataFrame:
    """A crawled page's share of the full result: shortened text and lists."""
    return merged.select("url", "title", F.substring("main_content", 1, C.PAGE_RESULT["main_content"]).alias("main_content"), F.slice("links", 1, C.PAGE_RESULT["links"]).alias("links"), F.slice("headings", 1, C.PAGE_RESULT["headings"]).alias("headings"))


def compact_snapshot(merged: DataFrame) -> DataFrame:
    """What a version in the history keeps of a document."""
    text = lambda c, n=None: F.coalesce(F.col(c).cast("string") if n is None else F.substring(c, 1, n), F.lit("")).alias(c)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return merged.select("url", text("title"), text("description", C.SNAPSHOT["description"]), text("main_content", C.SNAPSHOT["main_content"]), text("language"), count("headings").alias("heading_count"), count("links").alias("link_count"))


def merge_back(own: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a job and of its pages, one a key: the job's own first, then those of the first page (``rank``)."""
    rest = [c for c in own.columns if c not in (*keys, "rank")]
    rows = own.select(*keys, *rest, F.lit(-1).cast("long").alias("rank")).unionByName(pages.select(*keys, *rest, F.col("rank").cast("long")))
    first = rows.groupBy(*keys).agg(F.min(F.struct("rank", *rest)).alias("f"))
    return first.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest], (F.col("f.rank") >= 0).alias("from_page"))


def payload_summary(payload: Column) -> Column:
    """First ten keys of a JSON object, the length of an array, else the kind of value."""
    p = F.trim(payload)
    keys = F.array_join(F.slice(F.json_object_keys(p), 1, 10), ",")
    kind = F.when(p.rlike('^"'), "str").when(p.isin("true", "false"), "bool").when(p == "null", "NoneType").when(p.rlike(r"^-?\d+$"), "int").when(p.rlike(r"^-?\d"), "float")
    return F.when(p.startswith("{"), keys).when(p.startswith("["), F.concat(F.lit("array["), F.json_array_length(p).cast("string"), F.lit("]"))).otherwise(kind)


def line_stats(text: Column) -> Column:
    """struct(lines, words, preview): non-empty trimmed lines, words, the first thirty lines."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ends), lambda s: F.regexp_replace(s, r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")), lambda s: s != "")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.struct(F.size(lines).cast("long").alias("lines"), F.size(words).cast("long").alias("words"), F.array_join(F.slice(lines, 1, 30), "\n").alias("preview"))


# ---------------------------------------------------------------- selection
def split_engines(selected: Column) -> tuple[Column, Column]:
    """(engines that may run side by side, the others), both in the order of selection."""
    side = F.array(*[F.lit(e) for e in C.PARALLEL])
    return F.array_intersect(selected, side), F.array_except(selected, side)


def preferred_first(engines: DataFrame, preferred: DataFrame) -> DataFrame:
    """engines(domain, engine_id, rank) ordered anew: preferred(domain, engine_id, rank) first, the rest as before."""
    p = preferred.select("domain", "engine_id", F.col("rank").alias("pref"))
    order = Window.partitionBy("domain").orderBy(F.asc_nulls_last("pref"), "rank")  # a domain has few engines
    return engines.join(p, ["domain", "engine_id"], "left").select("domain", "engine_id", F.row_number().over(order).cast("long").alias("position"))


def top_candidates(endpoints: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """The ``n`` highest scores of each key, by a partial top and a final one, so that no task holds a key."""
    order = [F.desc(score), F.asc("url")]
    part = endpoints.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))).where(F.col("r") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= n).drop("part", "r")


def valid_css(selector: Column) -> Column:
    s = F.coalesce(selector, F.lit(""))
    return (F.trim(s) != "") & ~s.rlike(r"(?i)<|javascript:")


def valid_id(name: Column, dash: bool = True) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"^[a-zA-Z0-9_-]{1,64}$" if dash else r"^[a-zA-Z0-9_]{1,64}$")


# ---------------------------------------------------------------- jobs
def listing(jobs: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest jobs."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created"), "job_id").offset(offset).limit(limit)


def phase_durations(marks: DataFrame) -> DataFrame:
    """marks(job, phase, kind 'start' or 'finish', ts): a finish and the start before it make an event; without one it took no time."""
    w = Window.partitionBy("job", "phase").orderBy("ts", "kind")
    before = marks.withColumn("b", F.lag(F.struct("kind", "ts")).over(w)).where("kind = 'finish'")
    start = F.when(F.col("b.kind") == "start", F.col("b.ts")).otherwise(F.col("ts"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return before.select("job", "phase", start.alias("start"), F.col("ts").alias("end"), (F.floor((micros(F.col("ts")) - micros(start) + 5) / 10) / 100).alias("duration_ms"))


def bans(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """outcomes(proxy, ok, ts, ...): every third failure in a row bans the proxy for BAN_SECONDS and starts the count again."""
    w = Window.partitionBy("proxy").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = outcomes.withColumn("run", F.count_if("ok").over(w)).where("NOT ok")
    streak = F.row_number().over(Window.partitionBy("proxy", "run").orderBy(*order))
    return runs.withColumn("streak", streak).where(F.col("streak") % C.BAN_FAILURES == 0).withColumn("until", F.col("ts") + F.expr(f"INTERVAL {C.BAN_SECONDS} SECONDS")).drop("run", "streak", "ok")


def notes(flags: DataFrame) -> DataFrame:
    """flags(domain, note): a domain's notes, sorted and joined."""
    return flags.where(F.trim(F.coalesce("note", F.lit(""))) != "").groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set(F.trim("note"))), ",").alias("notes"))


def stale(queues: DataFrame, ttl_s: int) -> DataFrame:
    """queues(job, created) older than ``ttl_s`` at the latest time in the table."""
    now = queues.agg(F.max("created").alias("now"))  # one row
    return queues.join(F.broadcast(now), F.unix_micros(F.col("created").cast("timestamp")) < F.unix_micros(F.col("now").cast("timestamp")) - ttl_s * 1_000_000).drop("now")


def append_versions(history: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``history`` and the rows of new(key, seq, ...) numbered on from each key's last version."""
    last = history.groupBy(key).agg(F.max("version").alias("last"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    numbered = new.withColumn("n", number).join(last, key, "left").withColumn("version", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long"))
    return history.unionByName(numbered.select(*history.columns))


def strip_ungrounded(fields: DataFrame, overlap: str) -> DataFrame:
    """Rows whose overlap with the page is high enough."""
    return fields.where(F.col(overlap) >= C.HALLUCINATION_OVERLAP)
