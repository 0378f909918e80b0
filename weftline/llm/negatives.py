"""Hard negatives by one-dimensional distance keys.

A vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, so that a high inner product
with an anchor is a small distance. Every augmented vector belongs to its nearest pivot, and its key is its distance
from it. Vectors are stored in the order of (pivot, key), cut into cells of that order and, where a cell has many
rows, into parts. By the triangle inequality, what lies within r of an anchor has a key within r of the anchor's
own distance from the pivot: a search scans those intervals of keys, takes exact integer scores there, and widens
them until the best that it may have missed is worse than the last that it keeps. For negatives the search begins
at the positive's own distance and ends at that of the lowest score that is allowed, so it scans an annulus.

Pivots, and the edges of cells, come from a bounded sample (SAMPLE rows) and decide speed alone. A round is a join
of the cells that the open anchors ask for with the stored parts; each pair of part and at most REQUESTS anchors is
one row of it, and what comes back are the best few of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments
from .common import drop_scratch, materialize, scratch_tables

SAMPLE = 2048
PIVOTS, MOST_CELLS = 16, 256
#: Rows of a part of a cell, and anchors that are scored against it together.
PART, REQUESTS = 1024, 256
#: A round's radius reaches the sample's row of this rank among those wanted; behind the last, everything is scanned.
STEPS = (2, 32)
POSITIVES = NEGATIVES = 5
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_VECTORS = "row long, vec_id long, known boolean, label long, dim int, norm long, vec binary"
_FLAT = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("known", pa.bool_()), ("label", pa.int64()), ("dim", pa.int32()), ("norm", pa.int64()), ("vec", pa.binary())])
_WINDOWS = "array<struct<w: int, hi: long, lo: long>>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("v")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        cols = [b.column(c).cast(_FLAT.field(c).type) for c in _FLAT.names[:-1]]
        yield pa.RecordBatch.from_arrays([*cols, segments.binaries(flat, first)], schema=_FLAT)


def _matrix(vecs, dim: int, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), dim).astype(dtype)


class Space:
    """Pivots and cells of the vectors of one length, from a sample of them. ``most``: the largest squared norm of all."""

    def __init__(self, dim: int, sample: np.ndarray, labels: np.ndarray, most: float, rows: float):
        self.dim, self.most, self.sample, self.labels = dim, most, sample, labels
        x = self.augmented(sample)
        k = max(1, min(PIVOTS, len(x) // 8))
        self.pivots = x[:: max(1, len(x) // k)][:k].copy() if len(x) else np.zeros((1, dim + 1))
        for _ in range(4):
            own = self.distances(x).argmin(axis=1) if len(x) else np.zeros(0, int)
            for p in range(len(self.pivots)):
                if (own == p).any():
                    self.pivots[p] = x[own == p].mean(axis=0)
        self.edges, self.first = [], [0]
        d = self.distances(x)
        own = d.argmin(axis=1)
        for p in range(len(self.pivots)):
            keys = d[own == p, p]
            n = int(np.clip(rows * len(keys) / max(1, len(x)) / PART, 1, MOST_CELLS))
            edges = np.unique(np.quantile(keys, np.arange(1, n) / n)) if n > 1 else np.zeros(0)
            self.edges.append(edges)
            self.first.append(self.first[-1] + len(edges) + 1)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, key) of vectors."""
        d = self.distances(self.augmented(x))
        own = d.argmin(axis=1)
        key = d[np.arange(len(d)), own]
        return np.array([self.first[p] + np.searchsorted(self.edges[p], k, "right") for p, k in zip(own.tolist(), key.tolist())], np.int64), key

    def reach(self, square: float, score: float) -> float:
        """The distance at which a vector has that score with an anchor of that squared norm."""
        return float(np.sqrt(max(0.0, square + self.most - 2.0 * score)))

    def cells(self, d: np.ndarray, inner: float, outer: float) -> set[int]:
        """Cells that may hold vectors between the two distances from an anchor that is ``d`` away from the pivots."""
        slack = 1e-9 * (np.sqrt(self.most) + d.max() + 1.0)
        found: set[int] = set()
        for p, (dp, edges) in enumerate(zip(d.tolist(), self.edges)):
            lo, hi = max(dp - outer, inner - dp) - slack, dp + outer + slack
            found.update(range(self.first[p] + int(np.searchsorted(edges, lo, "left")), self.first[p] + int(np.searchsorted(edges, hi, "right")) + 1))
        return found


def _spaces(rows: DataFrame) -> Callable[[int], Space]:
    """The space of each vector length; lengths that the sample lacks have one pivot and one cell."""
    s = rows.agg(F.count("*").alias("n"), F.max("norm").alias("most")).first()
    n, most = s["n"], float(s["most"] or 0)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "label", "vec").collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(r["dim"], []).append(r)
    known = {d: Space(d, _matrix([r["vec"] for r in rs], d), np.array([r["label"] for r in rs]), most, n * len(rs) / len(sample)) for d, rs in by.items()}

    def space(dim: int) -> Space:
        return known[dim] if dim in known else Space(dim, np.zeros((0, dim)), np.zeros(0, np.int64), most, 0)

    return space


def _keyed(space: Callable[[int], Space]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                cell, key = space(int(dim)).cell(_matrix(part["vec"], int(dim)))
                yield part.assign(cell=cell, key=key)

    return run


def _part(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a part of a cell, its vectors in the order of their keys."""
    pdf = pdf.sort_values(["key", "row"])
    row = [pdf[c].iat[0] for c in ("dim", "cell", "part")] + [pdf[c].to_numpy().tobytes() for c in ("row", "vec_id", "known", "label")] + [pdf["norm"].max(), b"".join(pdf["vec"])]
    return pd.DataFrame([row], columns=["dim", "cell", "part", "rows", "ids", "known", "labels", "most", "vecs"])


_STORE = "dim int, cell long, part int, rows binary, ids binary, known binary, labels binary, most long, vecs binary"


def _target(space: Space, scores: np.ndarray, windows: list, step: int) -> int:
    """The score down to which a round looks: that of the sample's row of the step's rank in each window, if it has one."""
    out = _MOST
    for w in windows:
        inside = scores[(scores <= w["hi"]) & (scores >= w["lo"])]
        if step < len(STEPS) and len(inside) >= STEPS[step]:
            out = min(out, int(np.partition(inside, -STEPS[step])[-STEPS[step]]))
        else:
            out = min(out, w["lo"])
    return out


def _plan(space: Callable[[int], Space], step: int, same: bool):
    """Adds to anchors the cells that a round has to scan, but for those of the rounds before, and ``bound``: better scores than that are in none of the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells, bounds = [], []
            for dim, label, norm, vec, windows in zip(pdf["dim"], pdf["label"], pdf["norm"], pdf["vec"], pdf["windows"]):
                s = space(int(dim))
                q = _matrix([vec], int(dim))[0]
                scores = s.sample @ q
                scores = scores[(s.labels == label) == same]
                d = s.distances(np.append(q, 0.0)[None])[0]
                top = max(w["hi"] for w in windows)
                inner = 0.0 if top == _MOST else s.reach(norm, top)
                seen: set[int] = set()
                for k in range(step + 1):
                    at = _target(s, scores, windows, k)
                    now = s.cells(d, inner, np.inf if at == _LEAST else s.reach(norm, at))
                    new, seen = now - seen, now
                cells.append(sorted(new))
                bounds.append(at if at == _LEAST else at + int(1e-9 * (s.most + norm)))
            yield pdf.assign(cells=cells, bound=bounds)

    return run


def _scan(same: bool, keep: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dim, rows, ids, known, labels, most, vecs, asked in zip(*(pdf[c] for c in ("dim", "rows", "ids", "known", "labels", "most", "vecs", "asked"))):
                rows, ids, labels, known = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(known, bool)
                exact = max(most, *(a["norm"] for a in asked)) <= 1 << 53  # no partial sum is beyond the product of the norms
                kind = np.float64 if exact else np.int64
                x = np.frombuffer(vecs, "<i4").reshape(len(rows), int(dim)).astype(kind)
                q = _matrix([a["vec"] for a in asked], int(dim), kind)
                for a, s in zip(asked, (q @ x.T).astype(np.int64)):
                    fit = (labels == a["label"]) == same
                    if same:
                        fit &= rows != a["row"]
                    for w in a["windows"]:
                        at = np.flatnonzero(fit & (s <= w["hi"]) & (s >= w["lo"]))
                        if len(at) > keep:
                            at = at[s[at] >= np.partition(s[at], -keep)[-keep]]
                        at = at[np.lexsort((rows[at], ids[at], ~known[at], -s[at]))][:keep]
                        out += [(a["row"], w["w"], int(s[k]), int(ids[k]) if known[k] else None, int(rows[k])) for k in at.tolist()]
            yield pd.DataFrame(out, columns=["anchor", "w", "score", "vec_id", "row"]).astype({"vec_id": "Int64"})

    return run


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best of each anchor and window, ranked."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _search(anchors: DataFrame, store: DataFrame, parts: DataFrame, space: Callable[[int], Space], same: bool, keep: int) -> DataFrame:
    """(anchor, w, score, vec_id, row, rank): the best of each of the anchors' ``windows`` of scores, of the same or another label."""
    best, pending = None, anchors
    for step in range(len(STEPS) + 1):
        plan = materialize(pending.mapInPandas(_plan(space, step, same), f"{_VECTORS}, windows {_WINDOWS}, cells array<long>, bound long"), "plan")
        asked = plan.select("dim", F.explode("cells").alias("cell"), F.struct("row", "label", "norm", "vec", "windows").alias("a"))
        load = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("salts"))
        asked = asked.join(load, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("a.row"), F.col("salts")))
        asked = asked.groupBy("dim", "cell", "salt").agg(F.collect_list("a").alias("asked"))
        asked = asked.join(parts.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part")), ["dim", "cell"])
        found = asked.join(store, ["dim", "cell", "part"]).mapInPandas(_scan(same, keep), "anchor long, w int, score long, vec_id long, row long")
        best = materialize(_best(found if best is None else best.drop("rank").unionByName(found), keep), "best")
        if step == len(STEPS):
            break
        have = best.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        w = plan.select(F.col("row").alias("anchor"), "bound", F.explode("windows").alias("x")).select("anchor", "bound", F.col("x.w").alias("w"), F.col("x.lo").alias("lo"))
        certain = ((F.col("n") == keep) & (F.col("worst") > F.col("bound"))) | (F.col("bound") < F.col("lo")) | (F.col("bound") == _LEAST)
        opened = w.join(have, ["anchor", "w"], "left").where(~F.coalesce(certain, F.lit(False))).select(F.col("anchor").alias("row")).distinct()
        pending = materialize(plan.drop("cells", "bound").join(opened, "row", "left_semi").select(*anchors.columns), "open")
        if not pending.limit(1).count():
            break
    return best


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: of the columns vec_id, label. An anchor's positives are its POSITIVES best other rows of the same
    label; a positive's negatives the NEGATIVES best rows of another label with a score of 80 to 100 hundredths of
    its own, so a negative positive_score has none. Components become floor(256 * x); scores are exact.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do those whose
    integer vector has a squared norm of 2^62 or more, for their scores need not fit a long. Rows with a null id
    take part, behind equal scores with an id, but are no anchors. Vectors of different lengths never meet; empty ones have score 0 among themselves. Repeated rows and ids are rows of their own: other rows of the same id
    may be positives, each row of an anchor's id is an anchor. Ties in score go by the smaller vec_id, then either
    way. Anchors with fewer rows return those. An empty table gives an empty table. Other columns don't matter.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = src.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    src = src.withColumn("v", F.transform("e", lambda x: F.floor(x * 256.0)))
    src = src.withColumn("square", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))).where(F.col("square") < float(1 << 62))
    id_, known = F.coalesce("vec_id", F.lit(_MOST)).alias("vec_id"), F.col("vec_id").isNotNull().alias("known")
    src = src.select(F.monotonically_increasing_id().alias("row"), id_, known, "label", F.size("v").alias("dim"), F.col("square").cast("long").alias("norm"), "v")
    since = scratch_tables()
    rows = materialize(src.mapInArrow(_pack, _VECTORS), "vectors")
    space = _spaces(rows)
    keyed = rows.mapInPandas(_keyed(space), f"{_VECTORS}, cell long, key double")
    keyed = materialize(keyed, "keyed")
    parts = materialize(keyed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("k")), "parts")
    keyed = keyed.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("k")).cast("int"))
    store = materialize(keyed.groupBy("dim", "cell", "part").applyInPandas(_part, _STORE), "store")
    anchors = rows.where("known").where(is_anchor)
    every = F.array(F.struct(F.lit(0).alias("w"), F.lit(_MOST).alias("hi"), F.lit(_LEAST).alias("lo"))).alias("windows")
    positives = _search(anchors.select("*", every), store, parts, space, True, POSITIVES)
    positives = materialize(positives.select("anchor", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low = F.expr("positive_score - positive_score div 5")
    spans = positives.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct("w", F.col("positive_score").alias("hi"), low.alias("lo"))).alias("windows"))
    asking = materialize(anchors.join(spans, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    negatives = _search(asking.select(*rows.columns, "windows"), store, parts, space, False, NEGATIVES)
    named = asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = negatives.select("anchor", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "w"]).join(named, "anchor")
    out = materialize(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    drop_scratch(since, out)
    return out
