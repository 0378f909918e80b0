"""Keyed streams with timers: rows of a key are taken in event time, and states go when their time has run out.

Every operator here is an ``InOrder`` processor. Rows that have arrived are held until the watermark passes them,
then folded in the order of (ts, seq), so what comes out doesn't depend on how the stream was cut into
micro-batches. A fold may ask to be woken at a later event time, which is how a stream puts out rows that no
input brings: evictions and heartbeats. A state that a fold gives up is removed from the store.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State variables and timers need this state store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Columns that rows may be held with, and how the state keeps a piece of each; times, which are never null, as their bytes.
HELD = {"at": "binary", "seq": "array<long>", "tag": "array<string>"}


class InOrder(StatefulProcessor):
    """Folds a key's rows (at: microseconds, seq, tag) in the order of time.

    Subclasses give the state's schema (longs, or null for none), the columns that they need of the rows and
    ``fold(key, state, due, until)``: ``due`` has arrays of those columns, of the rows up to the watermark ``until`` in
    order, maybe none. It returns (state or None, output columns as a dict, when to be woken or None).

    Calls of the state store are few a key, whatever its rows: rows are held by pieces, not one by one, and a timer that
    has become needless rings rather than being looked up and deleted, for a fold without rows changes nothing.
    """

    state_schema = "last long"
    columns = ("at", "seq")
    #: Most rows in a piece.
    piece_rows = 10_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{c} {HELD[c]}" for c in self.columns))
        self.now = handle.getValueState("now", self.state_schema)
        self.done: set = set()  # keys that this task has folded up to the watermark

    def fold(self, key, state: tuple | None, due: dict[str, np.ndarray], until: int) -> tuple:
        raise NotImplementedError

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # timers tick in milliseconds

    def _piece(self, rows: dict[str, np.ndarray]) -> tuple:
        return tuple(rows[c].astype("<i8").tobytes() if c == "at" else rows[c].tolist() for c in self.columns)

    def _rows(self, pieces: list[tuple]) -> dict[str, np.ndarray]:
        found = {}
        for c, got in zip(self.columns, zip(*pieces) if pieces else [()] * len(self.columns)):
            flat = b"".join(got) if c == "at" else list(itertools.chain.from_iterable(got))
            found[c] = np.frombuffer(flat, "<i8") if c == "at" else np.array(flat, object if c == "tag" or None in flat else np.int64)
        return found

    def _order(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """By time, then by seq, null last."""
        seq = rows.get("seq")
        if seq is None:
            return np.argsort(rows["at"], kind="stable")
        none = np.equal(seq, None) if seq.dtype == object else np.zeros(len(seq), bool)
        return np.lexsort((np.where(none, 0, seq).astype(np.int64), none, rows["at"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for lo in range(0, len(pdf), self.piece_rows):
                piece = {c: pdf[c].to_numpy()[lo : lo + self.piece_rows] for c in self.columns}
                if "seq" in piece and piece["seq"].dtype.kind == "f":  # pandas' way of longs with nulls
                    piece["seq"] = np.array([None if x != x else int(x) for x in piece["seq"].tolist()], object)
                self.held.appendValue(self._piece(piece))
                least = int(piece["at"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(max(first, timerValues.getCurrentWatermarkInMs() * 1000 + 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:
            return
        self.done.add(key)
        until = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = list(self.held.get())
        before = self.now.get() if self.now.exists() else None
        if not pieces and before is None:
            return
        held = self._rows(pieces)
        order = self._order(held)
        ready = int(np.searchsorted(held["at"][order], until, side="right"))
        due, rest = ({c: x[part] for c, x in held.items()} for part in (order[:ready], order[ready:]))
        state, out, again = self.fold(key[0], before, due, until)
        left = len(rest["at"])
        if left and ready:
            self.held.put([self._piece({c: x[lo : lo + self.piece_rows] for c, x in rest.items()}) for lo in range(0, left, self.piece_rows)])
        elif pieces and not left:
            self.held.clear()
        if state is not None:
            self.now.update(state)
        elif before is not None:
            self.now.clear()
        waits = [*([] if again is None else [again]), *([int(rest["at"].min())] if left else [])]
        if waits:
            self._wake(min(waits))
        if out and len(next(iter(out.values()))):
            yield pd.DataFrame({"key": key[0], **out})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: InOrder, out: str, delay: str) -> DataFrame:
    """Rows (key, ts, seq, tag) through ``processor``; ``out``: its columns behind the key. Rows later than ``delay`` behind the newest are dropped."""
    r = rows.select(F.col("key").cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("tag").cast("string").alias("tag"))
    r = r.select("key", "ts", *processor.columns)
    return r.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key long, {out}", outputMode="Append", timeMode="EventTime")


class Eviction(InOrder):
    """A queue is open from its first row until ``ttl`` microseconds without one; then it is evicted: a row goes out, the state goes."""

    state_schema = "created long, last long, n long"
    columns = ("at",)

    def __init__(self, ttl: int):
        self.ttl = ttl

    def fold(self, key, state, due, until):
        at = due["at"]
        created, last, n = (np.array([x], np.int64) for x in state) if state else (np.zeros(0, np.int64),) * 3
        first, end, count = np.append(created, at), np.append(last, at), np.append(n, np.ones(len(at), np.int64))
        opens = np.append(True, first[1:] - end[:-1] >= self.ttl)[: len(first)]
        begin = np.flatnonzero(opens)
        first, end, count = first[begin], end[np.append(begin[1:], len(end)) - 1] if len(begin) else end, np.add.reduceat(count, begin) if len(begin) else count
        gone = end + self.ttl <= until
        out = {"created": first[gone], "last": end[gone], "n": count[gone]}
        if gone.all():
            return None, out, None
        return (int(first[-1]), int(end[-1]), int(count[-1])), out, int(end[-1]) + self.ttl


class Progress(InOrder):
    """Every row goes out as an event; while a job is open, a heartbeat every ``gap`` microseconds without one; a row with a tag of ``terminal`` closes the job."""

    columns = ("at", "seq", "tag")

    def __init__(self, gap: int, terminal: tuple[str, ...]):
        self.gap, self.terminal = gap, terminal

    def fold(self, key, state, due, until):
        at, tag, seq = due["at"], due["tag"], due["seq"]
        ends = np.isin(tag.astype(str), self.terminal)
        # heartbeats stand between a row (or the last one sent) and the next, or the watermark
        begin = np.append([state[0]] if state else np.zeros(0, np.int64), at).astype(np.int64)
        live = np.append([True] if state else np.zeros(0, bool), ~ends).astype(bool)
        stop = np.append(begin[1:], until + 1)[: len(begin)]
        beats = np.where(live, np.maximum(0, (stop - 1 - begin) // self.gap), 0)
        of = np.repeat(np.arange(len(begin)), beats)
        times = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(beats) - beats, beats) + 1) * self.gap
        out = {
            "at": np.append(at, times),
            "seq": pd.array([*seq.tolist(), *[None] * len(times)], "Int64"),
            "kind": np.append(np.where(ends, "end", "event").astype(object), np.full(len(times), "heartbeat", object)),
            "tag": np.append(tag, np.full(len(times), None, object)),
        }
        if not len(begin) or not live[-1]:
            return None, out, None
        last = int(begin[-1] + beats[-1] * self.gap)
        return (last,), out, last + self.gap


class Throttle(InOrder):
    """The earliest permitted start of each row: at its time, but not before ``delay`` microseconds behind the start before it.

    The state goes when the delay behind the last start has run out.
    """

    def __init__(self, delay: int):
        self.delay = delay

    def fold(self, key, state, due, until):
        at, steps = due["at"], np.arange(len(due["at"])) * self.delay
        ready = state[0] + self.delay if state else np.iinfo(np.int64).min
        start = np.maximum(np.maximum.accumulate(at - steps), ready) + steps if len(at) else at
        last = int(start[-1]) if len(at) else state[0] if state else None
        out = {"seq": due["seq"], "at": at, "start": start}
        if last is None or last + self.delay <= until:
            return None, out, None
        return (last,), out, last + self.delay


def evictions(rows: DataFrame, ttl_s: int, delay: str) -> DataFrame:
    """rows(key, ts, seq, tag): (key, created, last, n, evicted) of each queue whose time has run out, as timestamps."""
    ttl = ttl_s * 1_000_000
    out = in_order(rows, Eviction(ttl), "created long, last long, n long", delay).withColumn("evicted", F.col("last") + ttl)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("created", "last", "evicted")})


def progress(rows: DataFrame, gap_s: int, terminal: tuple[str, ...], delay: str) -> DataFrame:
    """rows(key, ts, seq, tag): the feed (key, ts, seq, kind, tag); kind is event, heartbeat or end."""
    out = in_order(rows, Progress(gap_s * 1_000_000, terminal), "at long, seq long, kind string, tag string", delay)
    return out.select("key", F.timestamp_micros("at").alias("ts"), "seq", "kind", "tag")


def throttled(rows: DataFrame, delay_us: int, delay: str) -> DataFrame:
    """rows(key, ts, seq, tag): (key, seq, ts, start); as crawl.earliest_starts gives for a whole table."""
    out = in_order(rows, Throttle(delay_us), "seq long, at long, start long", delay)
    return out.select("key", "seq", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("start").alias("start"))
