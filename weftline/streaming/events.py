"""Event-time operators. The transformations work on batches and streams alike; run_* drive a stream to its end."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import session


def read_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 8) -> DataFrame:
    """The table's files as a stream; the zone-less timestamps become instants, which event time needs."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str) -> DataFrame:
    w = F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, every: str) -> DataFrame:
    return events.groupBy(F.window("ts", length, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events with less than ``gap`` between them; a session stops ``gap`` after its last event."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_of(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.min("ts").alias("first_ts"))


def dedup_within(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First event of each key, late copies dropped while the watermark keeps the key."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """Admission of events(user_id, event_id, ts): a user's bucket refills at a steady rate; an event takes one token or is refused.

    State is two numbers a user. Events of one trigger are taken in time order.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, ts in zip(rows["event_id"], rows["ts"]):
            now = ts.timestamp()
            if last is not None:
                tokens = min(capacity, tokens + max(0.0, now - last) * per_second)
            last = now if last is None else max(last, now)
            ok = tokens >= 1.0
            tokens -= 1.0 if ok else 0.0
            out.append((key[0], event, ok, round(tokens, 6)))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "admitted", "tokens"])

    return (
        events.select("user_id", "event_id", "ts")
        .groupBy("user_id")
        .applyInPandasWithState(admit, "user_id long, event_id long, admitted boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
    )


def keyed_frames(rows: DataFrame, key: str, order: list[str], state: str, out: str, start: tuple, fold) -> DataFrame:
    """A state a key, carried over its rows in ``order`` within each micro-batch: fold(state, frame) gives (new state, output columns).

    ``state`` and ``out`` are schemas; ``key`` is a long and the first output column. A frame holds a key's rows of one
    micro-batch. The state outlives restarts with the stream's checkpoint and is kept for good: what it knows of a
    key (its last version, its streak) has no date of expiry. States that have one are in ``keyed``.
    """

    def run(key_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches)).sort_values(order, kind="stable", ignore_index=True)
        now, columns = fold(tuple(held.get) if held.exists else start, frame)
        held.update(now)
        yield pd.DataFrame({key: key_[0], **columns})

    return rows.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def keyed_fold(rows: DataFrame, key: str, order: list[str], state: str, out: str, start: tuple, step) -> DataFrame:
    """As ``keyed_frames``, row by row, for states that only a step from row to row tells: step(state, row) gives (new state, output row)."""
    names = [c.split()[0] for c in out.split(", ")]

    def fold(now: tuple, frame: pd.DataFrame) -> tuple:
        got = []
        for r in frame.to_dict("records"):
            now, row = step(now, r)
            got.append(row)
        columns = pd.DataFrame(got, columns=names)
        return now, {c: columns[c] for c in names if c != key}

    return keyed_frames(rows, key, order, state, out, start, fold)


def change_on_arrival(versions: DataFrame) -> DataFrame:
    """versions(key, version, content_hash): whether each differs from the one that came before it."""

    def fold(state: tuple, frame: pd.DataFrame) -> tuple:
        now = frame["content_hash"]
        before = now.shift(1)
        before.iloc[0] = state[0]
        same = (now == before) | (now.isna() & before.isna())
        return (now.iloc[-1],), {"version": frame["version"], "changed": ~same, "previous_hash": before.where(~same, None)}

    return keyed_frames(versions, "key", ["version"], "last string", "key long, version long, changed boolean, previous_hash string", (None,), fold)


def selector_streaks(hits: DataFrame, dead_after: int) -> DataFrame:
    """hits(key, event_id, ts, hit): misses in a row up to each event, and whether the selector is dead."""

    def fold(state: tuple, frame: pd.DataFrame) -> tuple:
        hit = frame["hit"].to_numpy(bool)
        at = np.arange(len(hit))
        last = np.maximum.accumulate(np.where(hit, at, -1))  # the last hit so far
        n = np.where(last < 0, at + 1 + state[0], at - last).astype(np.int64)
        return (int(n[-1]),), {"event_id": frame["event_id"], "miss_streak": n, "dead": n >= dead_after}

    return keyed_frames(hits, "key", ["ts", "event_id"], "n long", "key long, event_id long, miss_streak long, dead boolean", (0,), fold)


#: Which control event a job's status admits, and what it becomes.
TRANSITIONS = {
    ("new", "submit"): "pending",
    ("pending", "start"): "running",
    ("pending", "cancel"): "cancelled",
    ("running", "pause"): "paused",
    ("running", "finish"): "done",
    ("running", "cancel"): "cancelled",
    ("paused", "start"): "running",
    ("paused", "cancel"): "cancelled",
    ("done", "submit"): "pending",
    ("cancelled", "submit"): "pending",
}


def queue_control(controls: DataFrame) -> DataFrame:
    """controls(key, event_id, ts, control): the job's status after each control event, and whether it was accepted."""

    def step(state: tuple, r: dict) -> tuple:
        after = TRANSITIONS.get((state[0], r["control"]))
        return (after or state[0],), (r["key"], r["event_id"], after or state[0], after is not None)

    return keyed_fold(controls, "key", ["ts", "event_id"], "status string", "key long, event_id long, status string, accepted boolean", ("new",), step)


def profile_totals(outcomes: DataFrame) -> DataFrame:
    """Running counts of outcomes(domain, engine_id, ok) by domain and engine."""
    return outcomes.groupBy("domain", "engine_id").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"))


@contextlib.contextmanager
def _conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream starts; a stream keeps those that it started with."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(stream: DataFrame, label: str, mode: str, write: str, folder: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    spark = stream.sparkSession
    folder = folder or session.scratch(spark, f"stream-{label}")
    schema = stream.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        # one folder a batch: a repeated epoch overwrites its own rows, so restarts neither lose nor double any
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if write == 'overwrite' else f'epoch={epoch}'}")

    with _conf(spark, conf or {}):
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
        run.awaitTermination()
    reader = spark.read.schema(schema)
    return reader.parquet(f"{folder}/out/all") if write == "overwrite" else reader.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """Final state of an aggregating stream."""
    return _run(stream, label, "complete", "overwrite")


def run_append(stream: DataFrame, label: str, folder: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """All rows that a stream put out. A ``folder`` given again resumes: only new input is read, and states go on."""
    return _run(stream, label, "append", "append", folder, conf)
