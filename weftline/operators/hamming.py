"""Links between 64-bit fingerprints that differ in few bits, and their connected components.

Fingerprints within d bits agree on at least k of d + k bands of bits, whatever k is, so a join on every choice
of k bands finds all of them. More fingerprints take a larger k, that is longer keys: a key's group then stays
small. Where that takes too many keys, bands are a third of the bits for eight bits of distance: two fingerprints then
differ in two bits of some band at most, so each meets the other when one bit of the band is flipped, whichever it is.
Groups that are large all the same are cut into a grid of cells. What leaves a batch of compared
cells is a spanning forest of its links, never all pairs. Before that, fingerprints are sorted by their bits, starting
at several of them, and meet the next few in each order: that connects most of a dense region, and what is connected
already is not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session

#: Orders in which fingerprints meet the NEXT ones behind them.
TURNS, NEXT = 8, 16
#: Groups of more rows than this are cut into a grid of cells of about twice as many.
CELL = 8192
#: Fingerprints a key that are aimed at.
LOAD = 64
MOST_BANDS = 4
#: Links of a batch that are held before they are reduced to a forest.
WAIT = 1 << 16
#: Tables of large groups' keys are broadcast up to so many rows of two numbers.
HOT_ROWS = 1 << 18


def masks(distance: int, n: int) -> list[int]:
    """Bit masks, one of which any two fingerprints within ``distance`` bits agree on; longer ones for larger ``n``."""
    k = next((k for k in range(1, MOST_BANDS) if n <= LOAD << (64 * k // (distance + k))), MOST_BANDS)
    edges = [64 * b // (distance + k) for b in range(distance + k + 1)]
    bands = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(bands, k)]


def balls(distance: int) -> list[tuple[int, list[int]]]:
    """(mask of a band, bits of it and none) for each of some bands, on one of which any two fingerprints within ``distance``
    bits differ in two bits at most: they agree there once at most one bit of each is flipped."""
    n = distance // 3 + 1
    edges = [64 * b // n for b in range(n + 1)]
    return [(_signed((1 << hi) - (1 << lo)), [0, *(_signed(1 << b) for b in range(lo, hi))]) for lo, hi in zip(edges, edges[1:])]


def keys(distance: int, n: int) -> list[tuple[int, list[int]]]:
    """(mask, flips) of the keys of ``n`` fingerprints: what is masked, changed by each of the flips."""
    whole, near = [(m, [0]) for m in masks(distance, n)], balls(distance)
    return whole if len(whole) <= sum(len(flips) for _, flips in near) else near


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        old = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == old).all():
            break
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _near_next(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (key, turned)."""
        held = None
        for pdf in batches:
            whole = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key, fp, label = whole["key"].to_numpy(), whole["fp"].to_numpy().view(np.uint64), whole["label"].to_numpy()
            found = []
            for d in range(1, min(NEXT, len(whole) - 1) + 1):
                near = np.flatnonzero((key[d:] == key[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= distance))
                found.append((label[near], label[near + d]))
            a, b = forest(*(np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1)))
            yield pd.DataFrame({"a": a, "b": b})
            held = whole.iloc[-NEXT:]

    return run


def neighbours(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b): some of the links between labels of prints(g, label, fp) of one g within ``distance`` bits: those of neighbours by their bits.

    The work grows with the table alone, and no key's rows have to meet in one task.
    """
    shifts = [64 * k // TURNS for k in range(TURNS)]
    turned = lambda s: F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")
    orders = F.array(*[F.struct(F.xxhash64("g", F.lit(s)).alias("key"), turned(s).alias("turned")) for s in shifts])
    rows = prints.select("label", "fp", F.inline(orders))
    return rows.repartitionByRange("key", "turned").sortWithinPartitions("key", "turned").mapInPandas(_near_next(distance), "a long, b long")


def _compare(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (key, i, j, label); those of one label are not compared."""
        held: list[pd.DataFrame] = []

        def links(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf[["key", "i", "j"]].to_numpy()
            fp, label = pdf["fp"].to_numpy().view(np.uint64), pdf["label"].to_numpy()
            cell = np.append(True, (key[1:] != key[:-1]).any(axis=1))
            stop, other = _ends(cell), _ends(cell | np.append(True, label[1:] != label[:-1]))
            # rows with most to compare come first, so those with something left are always the first ones
            at = np.argsort(other - stop, kind="stable")
            size, to, own = (stop - other)[at], other[at], fp[at]
            top, found, wait = label.copy(), [], []

            def join() -> None:
                nodes, tops = forest(*(np.concatenate([np.zeros(0, np.int64), *[w[k] for w in wait]]) for k in (0, 1)))
                wait.clear()
                if len(nodes):
                    found.append((nodes, tops))
                    here = np.minimum(np.searchsorted(nodes, top), len(nodes) - 1)
                    top[:] = np.where(nodes[here] == top, tops[here], top)

            def add(x: np.ndarray, y: np.ndarray) -> None:
                new = top[x] != top[y]
                if new.any():
                    wait.append((top[x][new], top[y][new]))
                    if sum(len(w[0]) for w in wait) > WAIT:
                        join()

            d = 0
            while (n := int(np.searchsorted(-size, -d))) > size[0] - d:
                near = np.flatnonzero(np.bitwise_count(own[:n] ^ fp[to[:n] + d]) <= distance)
                add(at[near], to[near] + d)
                d += 1
            for k in range(n):  # few rows with much left: one by one
                near = np.flatnonzero(np.bitwise_count(own[k] ^ fp[to[k] + d : to[k] + size[k]]) <= distance)
                add(np.full(len(near), at[k]), to[k] + d + near)
            join()
            a, b = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))
            return pd.DataFrame({"a": a, "b": b})

        for pdf in batches:
            if not len(pdf):
                continue
            whole = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            key = whole[["key", "i", "j"]].to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1  # the last cell may go on
            held = [whole.iloc[last:]]
            if last:
                yield links(whole.iloc[:last])
        if held:
            yield links(held[0])

    return run


def _ends(begins: np.ndarray) -> np.ndarray:
    """For each row the end of its run; ``begins`` says where runs begin."""
    edges = np.append(np.flatnonzero(begins), len(begins))
    return np.repeat(edges[1:], np.diff(edges))


def _key(value: Column, mask: Column | str, flip: Column) -> Column:
    return F.xxhash64("g", mask, value.bitwiseXOR(flip))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= HOT_ROWS else rows


def _hot(prints: DataFrame, chosen: list[tuple[int, list[int]]]) -> DataFrame:
    """(key, k): keys of more than CELL rows, and of how many cells a side their grid is.

    Rows are counted by what they are masked to, before flips. A key of many rows has one of many among those that it is made of.
    """
    flips = F.element_at(F.create_map(*[x for m, every in chosen for x in (F.lit(m).cast("long"), F.array(*[F.lit(f).cast("long") for f in every]))]), F.col("mask"))
    rows = prints.select("g", "fp", F.explode(F.array(*[F.lit(m).cast("long") for m, _ in chosen])).alias("mask"))
    values = rows.groupBy("g", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).agg(F.count("*").alias("n")).checkpoint()
    keyed = lambda v: v.select("g", "mask", "value", "n", F.explode(flips).alias("flip")).select(_key(F.col("value"), "mask", F.col("flip")).alias("key"), "n")
    most = max(len(every) for _, every in chosen)
    may = keyed(values.where(F.col("n") * most > CELL)).select("key").distinct().checkpoint()
    sizes = keyed(values).join(_small(may), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
    return sizes.where(F.col("n") > CELL).select("key", F.ceil(F.col("n") / CELL).cast("int").alias("k")).checkpoint()


def links(prints: DataFrame, distance: int, chosen: list[tuple[int, list[int]]]) -> DataFrame:
    """(a, b): links between labels of prints(g, label, fp) that connect all of one g within ``distance`` bits that agree on a key."""
    every = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip")) for m, flips in chosen for f in flips])
    rows = prints.select("g", "label", "fp", F.inline(every))
    rows = rows.select(_key(F.col("fp").bitwiseAND(F.col("mask")), "mask", F.col("flip")).alias("key"), "label", "fp")
    rows = rows.join(_small(_hot(prints, chosen)), "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int"))
    rows = rows.select("key", "label", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "label", "fp")
    cells = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "label")
    return cells.mapInPandas(_compare(distance), "a long, b long")


def connect(prints: DataFrame, distance: int) -> DataFrame:
    """(node, component) of prints(g, node, fp): the least node that links of at most ``distance`` bits within one g lead to."""
    session.checkpoints(prints.sparkSession)
    # rows are few bytes, but make many keys: they are dealt out evenly, not by their bytes
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = prints.select("g", "node", "fp", F.col("node").alias("label")).repartition(parts, "node").checkpoint()
    every = keys(distance, now.count())
    for part in (neighbours, lambda p, d: links(p, d, every)):
        found = components(part(now, distance)).withColumnRenamed("node", "label")
        now = now.join(found, "label", "left").select("g", "node", "fp", F.coalesce("component", "label").alias("label")).repartition(parts, "node").checkpoint()
    return now.select("node", F.col("label").alias("component"))


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written and read again. A checkpoint keeps facts of its plan, and over rounds of joins planning took longer and longer."""
    path = session.scratch(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): its least connected node.

    Each round hooks every node to its least neighbour if that is less, follows the hooks to their ends and
    moves the edges there; edges inside a component vanish, so there are fewer every round.
    """
    session.checkpoints(edges.sparkSession)
    ordered = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = _cut(edges.where("a <> b").select(*ordered("a", "b")).distinct())
    labels = None
    while e.limit(1).count():
        hooks = _cut(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("top")))
        while True:
            over = hooks.select(F.col("node").alias("top"), F.col("top").alias("over"))
            moved = _cut(hooks.join(over, "top", "left").select("node", F.coalesce("over", "top").alias("top"), F.col("over").isNotNull().alias("moved")))
            hooks = moved.select("node", "top")
            if not moved.where("moved").limit(1).count():
                break
        if labels is None:
            labels = hooks.select("node", F.col("top").alias("component"))
        else:
            top = hooks.select(F.col("node").alias("component"), "top")
            new = hooks.join(labels.select("node"), "node", "left_anti").select("node", F.col("top").alias("component"))
            labels = _cut(labels.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")).unionByName(new))
        at = lambda side: hooks.select(F.col("node").alias(side), F.col("top").alias(f"{side}_top"))  # noqa: E731, B023
        e = e.join(at("hi"), "hi", "left").join(at("lo"), "lo", "left").select(F.coalesce("hi_top", "hi").alias("x"), F.coalesce("lo_top", "lo").alias("y"))
        e = _cut(e.where("x <> y").select(*ordered("x", "y")).distinct())
    if labels is None:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
