"""Metrics taken while rows pass by: one observation in a query's own pass, and a listener for streams."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .. import constants as C


def measures(ok: str = "ok", seconds: str = "elapsed_s") -> list[Column]:
    """Aggregates of a pass: runs, failures, the sum, count and greatest of latencies, and cumulative counts at the fixed bounds."""
    s = F.col(seconds)
    return [
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col(ok)).alias("failures"),
        F.coalesce(F.sum(s), F.lit(0.0)).alias("seconds_sum"),
        F.count(s).alias("seconds_count"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("seconds_max"),
        *[F.count_if(s <= b).alias(f"le_{k}") for k, b in enumerate(C.LATENCY_BUCKETS)],
    ]


def observed(rows: DataFrame, name: str = "outcomes", ok: str = "ok", seconds: str = "elapsed_s") -> tuple[DataFrame, Observation]:
    """``rows``, and an observation that holds their measures once an action has run over them: no second pass."""
    o = Observation(name)
    return rows.observe(o, *measures(ok, seconds)), o


def exposition(values: dict, gauges: dict[str, float] | None = None, prefix: str = "engine") -> str:
    """The measures and ``gauges`` in the text format of metrics scrapers."""
    lines = [f"# TYPE {prefix}_runs_total counter", f"{prefix}_runs_total {values['runs']}", f"# TYPE {prefix}_failures_total counter", f"{prefix}_failures_total {values['failures']}"]
    lines.append(f"# TYPE {prefix}_latency_seconds histogram")
    lines += [f'{prefix}_latency_seconds_bucket{{le="{b}"}} {values[f"le_{k}"]}' for k, b in enumerate(C.LATENCY_BUCKETS)]
    lines += [f'{prefix}_latency_seconds_bucket{{le="+Inf"}} {values["seconds_count"]}', f"{prefix}_latency_seconds_sum {values['seconds_sum']}", f"{prefix}_latency_seconds_count {values['seconds_count']}"]
    for k, v in sorted((gauges or {}).items()):
        lines += [f"# TYPE {k} gauge", f"{k} {v}"]
    return "\n".join(lines) + "\n"


class LiveMetrics(StreamingQueryListener):
    """Sums of a stream's observed measures over its micro-batches, and gauges of the last one. Add it with ``spark.streams.addListener``.

    The stream has to be observed under ``name``: ``rows.observe(name, *measures())``. A batch that runs again after
    a failure is counted once: the measures of a batch id replace those that it had.
    """

    def __init__(self, name: str):
        self.name, self._batches, self._last, self._lock = name, {}, {}, threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._last["streams_active"] = self._last.get("streams_active", 0) + 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        got = p.observedMetrics.get(self.name)
        with self._lock:
            if got is not None and p.numInputRows:
                self._batches[str(p.id), p.batchId] = got.asDict()
            self._last["input_rows_per_second"] = p.inputRowsPerSecond
            self._last["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._last["streams_active"] = self._last.get("streams_active", 1) - 1

    def values(self) -> dict:
        """Measures over all batches so far."""
        with self._lock:
            rows = list(self._batches.values())
        keys = rows[0].keys() if rows else ()
        return {k: max(r[k] for r in rows) if k.endswith("_max") else sum(r[k] for r in rows) for k in keys}

    def gauges(self) -> dict:
        with self._lock:
            return dict(self._last)
