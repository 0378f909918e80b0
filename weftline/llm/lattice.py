"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions by a few fixed random matrices, and every projection is decoded
to its nearest E8 lattice point: the vector's home cell in that table. A vector also probes the neighbouring
cells that lie nearest to its projection. Vectors that share a cell, at least one of them at home there, are
candidates. Larger tables get narrower cells and more of them, so that a cell's rows don't grow in proportion.

What travels to the cells are ids and sketches (the signs of 128 random projections), not vectors: sketches that
differ in more bits than those of a pair at the threshold ever do rule a candidate out. Only rows with a
candidate left fetch their vector, and cosines are taken in double precision from the numbers as stored.

Exact copies are folded first, so one very common vector is one row. Cells with many rows are cut into a grid of
blocks. A pair that meets in several cells counts only at its first meeting, which both sides' cells tell, so
link counts need no list of pairs; what leaves a batch of blocks is a count per vector and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hamming import forest
from .common import drop_scratch, materialize, scratch_tables
from .components import connected_components

COSINE = 0.9
PROBES = 6
#: (edge of the lattice in units of a projected coordinate's standard deviation, tables): by simulation each finds
#: a pair at the threshold with a probability of about 0.985.
PLANS = ((1.6, 4), (1.3, 6), (1.0, 15), (0.8, 39), (0.65, 112), (0.5, 525))
#: What comparing two sketches costs, in units of sending a row to a cell.
_COMPARE = 0.01
#: Sketches of vectors at the threshold differ in 18 of 128 bits, give or take 4; those of unrelated ones in 64.
SKETCH = 46
#: Cells with more rows than this are cut into blocks of about this many.
BLOCK = 512


def plan(n: int) -> tuple[float, int]:
    """(width, tables) for ``n`` vectors: the cheapest by rows sent and sketches compared."""

    def cost(width: float, tables: int) -> float:
        meet = (width / (2 * np.sqrt(np.pi))) ** 8 * (1 + 2 * PROBES)  # of unrelated vectors, in one table
        return tables * (1 + PROBES + _COMPARE * n * meet)

    return min(PLANS, key=lambda p: cost(*p))


@lru_cache(maxsize=8)
def _planes(dim: int, width: float, tables: int) -> np.ndarray:
    return np.random.default_rng(20_240_229 + dim).normal(size=(tables * 8, dim)) / width


@lru_cache(maxsize=8)
def _sketch_planes(dim: int) -> np.ndarray:
    return np.random.default_rng(20_250_301 + dim).normal(size=(128, dim))


def sketches(unit: np.ndarray) -> np.ndarray:
    """(n, 2): signs of 128 projections."""
    return np.packbits(unit @ _sketch_planes(unit.shape[1]).T > 0, axis=1).view(np.int64)


@lru_cache(maxsize=1)
def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            whole.append(v)
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + halves)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even coordinate sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    d = (x - r)[odd]
    worst = np.abs(d).argmax(axis=1)
    r[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row of ``x``."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _keys(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    h = table.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8):
        h = (h ^ (2 * points[..., k]).astype(np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, width: float, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, tables) and probed cells (n, tables, PROBES). Each row depends on its vector alone, bit by bit."""
    n, dim = unit.shape
    planes = _planes(dim, width, tables)
    home, near = np.empty((n, tables), np.int64), np.empty((n, tables, PROBES), np.int64)
    shortest = _minimal_vectors()
    step = max(1, (1 << 20) // planes.size)
    for lo in range(0, n, step):
        x = unit[lo : lo + step]
        p = (x[:, None, :] * planes[None, :, :]).sum(axis=2).reshape(-1, 8)  # no BLAS: its rounding depends on the batch
        point = decode_e8(p)
        rest = p - point
        score = sum(rest[:, k, None] * shortest[None, :, k] for k in range(8))
        best = np.argpartition(-score, PROBES, axis=1)[:, :PROBES]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(-score, best, axis=1), axis=1, kind="stable"), axis=1)
        t = np.tile(np.arange(tables), len(x))
        home[lo : lo + step] = _keys(point, t).reshape(-1, tables)
        near[lo : lo + step] = _keys(point[:, None, :] + shortest[best], t[:, None]).reshape(-1, tables, PROBES)
    return home ^ _mark(dim), near ^ _mark(dim)


def _mark(dim: int) -> np.int64:
    return np.int64(dim * 0x5851F42D4C957)


def _stored(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, squares of their norms) in double precision, of rows of ``dim`` numbers in the precision they came in. Each is scaled by a power of two, which is exact, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(rows), f"<f{len(rows[0]) // dim}").reshape(-1, dim).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, (x * x).sum(axis=1)


def _spread(width: float, tables: int, dtype: np.dtype):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len) // dtype.itemsize):
                for lo in range(0, len(part), 512):
                    p = part.iloc[lo : lo + 512]
                    x, square = _stored(list(p["vec"]), dim)
                    unit = x / np.sqrt(square)[:, None]
                    home, near = cells(unit, width, tables)
                    cell = np.concatenate([home, near.reshape(len(p), -1)], axis=1)
                    reps, sk = cell.shape[1], sketches(unit)
                    yield pd.DataFrame(
                        {
                            "cell": cell.ravel(),
                            "node": np.repeat(p["node"].to_numpy(), reps),
                            "home": np.tile(np.arange(reps) < home.shape[1], len(p)),
                            "s0": np.repeat(sk[:, 0], reps),
                            "s1": np.repeat(sk[:, 1], reps),
                        }
                    )

    return run


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by (cell, row, col, side), with no block cut in two, and each row's block number."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        whole = pd.concat([*held, pdf], ignore_index=True) if held else pdf
        key = whole[["cell", "row", "col"]].to_numpy()
        last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
        held = [whole.iloc[last:]]
        if last:
            yield whole.iloc[:last].reset_index(drop=True), _numbers(key[:last])
    if held:
        whole = held[0].reset_index(drop=True)
        yield whole, _numbers(whole[["cell", "row", "col"]].to_numpy())


def _numbers(key: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum((key[1:] != key[:-1]).any(axis=1)))


def _pairs(pdf: pd.DataFrame, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one block that a cell makes candidates: ``side`` 0 is at home and comes first, 2 is at home and meets side 0 only
    (in blocks of a larger cell, where it is also the other way round: there the smaller node comes first), 1 probes."""
    side, split, node = pdf["side"].to_numpy(), pdf["split"].to_numpy(), pdf["node"].to_numpy()
    at, d = np.flatnonzero(side == 0), 1
    while len(at := at[at + d < len(pdf)]) and len(at := at[block[at + d] == block[at]]):
        to = at + d
        ok = (node[at] != node[to]) & (~split[at] | (side[to] == 1) | ((side[to] == 2) & (node[at] < node[to])))
        yield at[ok], to[ok]
        d += 1


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that have a candidate in their block whose sketch is near enough."""
    for pdf, block in _whole_blocks(batches):
        s0, s1 = (pdf[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))
        keep = np.zeros(len(pdf), bool)
        for a, b in _pairs(pdf, block):
            near = np.bitwise_count(s0[a] ^ s0[b]).astype(np.int64) + np.bitwise_count(s1[a] ^ s1[b]) <= SKETCH
            keep[a[near]] = keep[b[near]] = True
        if keep.any():
            yield pdf.loc[keep, ["cell", "row", "col", "node", "side", "split"]]


def _first_meeting(ha: np.ndarray, na: np.ndarray, hb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Index of the first cell at which pairs of vectors meet, from their home and probed cells; a has the smaller node."""
    meet = np.stack([ha == hb, (ha[:, :, None] == nb).any(axis=2), (hb[:, :, None] == na).any(axis=2)], axis=2)
    return meet.reshape(len(ha), -1).argmax(axis=1)


def _links(width: float, tables: int, dtype: np.dtype):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (node, n, other): n more links of node; other: a link of the forest or null."""
        for pdf, block in _whole_blocks(batches):
            node, copies, cell, side = (pdf[c].to_numpy() for c in ("node", "copies", "cell", "side"))
            dims = pdf["vec"].map(len).to_numpy() // dtype.itemsize
            x, square = np.zeros((len(pdf), int(dims.max()))), np.zeros(len(pdf))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x[rows, :dim], square[rows] = _stored([pdf["vec"].iat[k] for k in rows], dim)
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            firsts, seconds = [], []
            for a, b in _pairs(pdf, block):
                for lo in range(0, len(a), 1 << 14):
                    i, j = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
                    near = np.einsum("nd,nd->n", x[i], x[j]) / np.sqrt(square[i] * square[j]) >= COSINE
                    i, j = i[near], j[near]
                    if not len(i):
                        continue
                    new = [k for k in np.unique(np.concatenate([i, j])).tolist() if int(node[k]) not in known]
                    for dim in np.unique(dims[new]):
                        rows = [k for k in new if dims[k] == dim]
                        for k, h, m in zip(rows, *cells(x[rows, :dim] / np.sqrt(square[rows])[:, None], width, tables)):
                            known[int(node[k])] = (h, m)
                    # the kind of this meeting: both at home, the smaller at home, the larger at home
                    small = np.where(node[i] < node[j], i, j)
                    big = i + j - small
                    kind = np.where(side[j] != 1, 0, np.where(small == i, 1, 2))
                    hs, ns, hb, nb = (np.stack([known[int(node[k])][w] for k in rows.tolist()]) for rows, w in ((small, 0), (small, 1), (big, 0), (big, 1)))
                    met = _first_meeting(hs, ns, hb, nb)
                    t, every = met // 3, np.arange(len(i))
                    ok = (met % 3 == kind) & (np.where(kind == 2, hb[every, t], hs[every, t]) == cell[i])
                    firsts.append(i[ok])
                    seconds.append(j[ok])
            if not firsts or not len(a := np.concatenate(firsts)):
                continue
            b = np.concatenate(seconds)
            who, inv = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
            count = np.bincount(inv, weights=np.concatenate([copies[b], copies[a]]).astype(float)).astype(np.int64)
            yield pd.DataFrame({"node": who, "n": count, "other": pd.array([None] * len(who), "Int64")})
            u, v = forest(node[a], node[b])
            yield pd.DataFrame({"node": u, "n": 0, "other": pd.array(v, "Int64")})

    return run


def _blocks(spread: DataFrame) -> DataFrame:
    """Rows of live cells with their block (row, col) and side, sorted by block; a cell of k * BLOCK rows is a grid of k by k blocks."""
    load = spread.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    load = load.where("homes > 0 AND n > 1").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    live = spread.join(load, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    base = ["cell", "node", "s0", "s1"]
    zero = F.lit(0)
    whole = live.where("k = 1").select(*base, zero.alias("row"), zero.alias("col"), F.when(F.col("home"), 0).otherwise(1).alias("side"), F.lit(False).alias("split"))
    grid = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = live.where("k > 1 AND home").select(*base, F.col("own").alias("row"), grid.alias("col"), zero.alias("side"), F.lit(True).alias("split"))
    right = live.where("k > 1").select(*base, grid.alias("row"), F.col("own").alias("col"), F.when(F.col("home"), 2).otherwise(1).alias("side"), F.lit(True).alias("split"))
    return whole.unionByName(left).unionByName(right)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell", "row", "col").sortWithinPartitions("cell", "row", "col", "side")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id, kept).

    Vectors link at cosine >= 0.9 of their components as stored. Vectors that are null, empty, zero, or hold a
    null or non-finite component link with nothing, nor do vectors of different lengths: n_links 0, component_id
    their own id. Repeated vectors link with each other (all but themselves); repeated rows and ids are rows of
    their own. Rows with a null id take no part: n_links 0, component_id null, kept false. Vectors of any length
    are taken whole. Ties don't arise: component_id is the smallest id. Other columns don't matter, whatever
    their names. An empty table gives an empty table.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(finite & F.exists("embedding", lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))

    kind = np.dtype("<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8")

    @F.pandas_udf("binary")
    def packed(e: pd.Series) -> pd.Series:
        return e.map(lambda v: np.asarray(v, kind).tobytes())

    classes = src.where(valid).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    folded = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "rep", "copies", "embedding", packed("embedding").alias("vec")), "vectors")
    width, tables = plan(folded.count())
    since = scratch_tables()
    spread = materialize(folded.select("node", "vec").mapInPandas(_spread(width, tables, kind), "cell long, node long, home boolean, s0 long, s1 long"), "cells")
    some = _by_block(_blocks(spread)).mapInPandas(_candidates, "cell long, row int, col int, node long, side int, split boolean")
    some = materialize(some, "candidates").join(folded.select("node", "copies", "vec"), "node")
    found = materialize(_by_block(some).mapInPandas(_links(width, tables, kind), "node long, n long, other long"), "links")
    drop_scratch(since, found)
    comp = connected_components(found.where("other IS NOT NULL"), "node", "other").withColumnRenamed("node", "member")
    linked = found.groupBy(F.col("node").alias("member")).agg(F.sum("n").alias("n"))
    named = folded.join(comp, F.col("node") == F.col("member"), "left").select("node", "rep", "copies", "embedding", F.coalesce("component", "node").alias("component"))
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("component_id"))
    named = named.join(least, F.col("component") == F.col("c")).join(linked, F.col("node") == F.col("member"), "left")
    named = named.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = src.where(valid).join(named, "embedding").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = src.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return out.unionByName(alone)
