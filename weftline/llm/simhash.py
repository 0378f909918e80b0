"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints are 64 bits. Bits 0-22 and 23-45 are each a point of the 23-bit cube, which the
perfect binary Golay code covers with radius 3: every point has exactly one codeword within 3.
An anchor is a pair of codewords. A fingerprint's home is the pair of its nearest codewords
(within the covering radius), and it is replicated to every anchor whose distance exceeds the
covering radius by at most the threshold, summed over both halves. Two fingerprints with at most
``threshold`` differing bits therefore meet at the smaller one's home: the search is exact.

That makes 2^24 anchors. Tables of more than MANY fingerprints take a third codeword, of the perfect Hamming code
of radius 1 on bits 46-60: 2^35 anchors and 2.5 times the replicas, and just as exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, drop_scratch, materialize, scratch_tables
from .components import connected_components

SHINGLE_WORDS = 3
THRESHOLD = 2
SEED = 42
#: Anchors with more homes than this are split into a grid of cells of about CELL homes by PROBES replicas.
HOT_HOMES = 64
CELL, PROBES = 1024, 1 << 14
#: Fingerprints from which on anchors have a third codeword: some tens of homes an anchor without it.
MANY = 1 << 28
_CHUNK = 1 << 16
_GOLAY_POLY = 0b101011100011  # fixed value: generator polynomial of the [23,12] Golay code


# ---------------------------------------------------------------- fingerprints
def _fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(islice(words, k, None) for k in range(SHINGLE_WORDS)))), len(words) - SHINGLE_WORDS + 1
    ones = np.zeros(64, np.int64)
    digests = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    while block := b"".join(islice(digests, _CHUNK)):
        rows = np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1)
        ones += rows.sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n)
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row: the 64-bit SimHash as a signed long; null and wordless texts give 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([_fingerprint(t) for t in pdf["text"]], np.int64)})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id long, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- covering code
def _syndrome(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1, _GOLAY_POLY << (bit - 11), 0)
    return r


def _hamming_syndrome(words: np.ndarray) -> np.ndarray:
    """Of the [15,11] code whose bit k is checked by the number k + 1."""
    r = np.zeros(len(words), np.int64)
    for bit in range(15):
        r ^= np.where((words >> bit) & 1, bit + 1, 0)
    return r


#: (first bit, length, covering radius, syndrome, number of syndromes) of the codes of an anchor's parts.
_GOLAY_LOW, _GOLAY_HIGH, _HAMMING = (0, 23, 3, _syndrome, 2048), (23, 23, 3, _syndrome, 2048), (46, 15, 1, _hamming_syndrome, 16)


@lru_cache(maxsize=4)
def _cosets(length: int, radius: int, syndrome, n: int, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess 0..threshold: (offsets by syndrome, error patterns) of at most the radius' weight, then radius + excess."""
    out = []
    for excess in range(threshold + 1):
        weights = range(radius + 1) if excess == 0 else [radius + excess]
        pats = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(length), w)], np.int64)
        syn = syndrome(pats)
        order = np.argsort(syn, kind="stable")
        out.append((np.searchsorted(syn[order], np.arange(n + 1)), pats[order]))
    return out


def _near(code: tuple, fps: np.ndarray, rows: np.ndarray, excess: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords, in their place, whose distance from the part of fps[rows] exceeds the covering radius by ``excess``: (index into rows, codeword)."""
    first, length, radius, syndrome, n = code
    words = (fps[rows] >> first) & ((1 << length) - 1)
    off, pats = _cosets(length, radius, syndrome, n, threshold)[excess]
    syn = syndrome(words)
    counts = off[syn + 1] - off[syn]
    idx = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(len(idx)) - np.repeat(np.cumsum(counts) - counts, counts)
    return idx, (words[idx] ^ pats[off[syn][idx] + within]) << first


def anchors(fps: np.ndarray, threshold: int = THRESHOLD, third: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each fingerprint, rows of the replicas, anchors of the replicas)."""
    codes = [_GOLAY_LOW, _GOLAY_HIGH, *([_HAMMING] if third else [])]
    everything = np.arange(len(fps))
    home = np.zeros(len(fps), np.int64)
    # (rows, anchors so far, excess so far)
    parts = [(everything, home, 0)]
    for code in codes:
        home = home | _near(code, fps, everything, 0, threshold)[1]
        grown = []
        for rows, keys, used in parts:
            for excess in range(threshold + 1 - used):
                i, c = _near(code, fps, rows, excess, threshold)
                grown.append((rows[i], keys[i] | c, used + excess))
        parts = grown
    return home, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _replicate(third: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                fps, rep = part["fp"].to_numpy(), part["rep"].to_numpy()
                home, rows, keys = anchors(fps, THRESHOLD, third)
                yield pd.DataFrame({"anchor": home, "fp": fps, "rep": rep, "is_home": True})
                yield pd.DataFrame({"anchor": keys, "fp": fps[rows], "rep": rep[rows], "is_home": False})

    return run


def _cell_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within one cell of a hot anchor, a spanning forest of the links between homes and replicas."""
    homes, probes = pdf[pdf["is_home"]], pdf[~pdf["is_home"]]
    hf, hr = homes["fp"].to_numpy(), homes["rep"].to_numpy()
    pf, pr = probes["fp"].to_numpy(), probes["rep"].to_numpy()
    parent = np.arange(len(hf))
    out_a, out_b = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for lo in range(0, len(pf), 1024):
        x = pf[lo : lo + 1024, None] ^ hf[None, :]
        linked = (np.bitwise_count(x.view(np.uint64)) <= THRESHOLD) & (x != 0)
        for p in np.flatnonzero(linked.any(axis=1)):
            hits = np.flatnonzero(linked[p])
            out_a.append(pr[lo + p])
            out_b.append(hr[hits[0]])
            first = root(hits[0])
            for h in hits[1:]:
                if (r := root(h)) != first:
                    parent[r] = first
                    out_a.append(hr[hits[0]])
                    out_b.append(hr[h])
    return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})


def fingerprint_links(groups: DataFrame, third: bool | None = None) -> DataFrame:
    """Edges (a, b) between the representatives of groups(fp, rep) that connect whatever links connect.

    Anchors with few homes are compared by a join on the anchor, where a replica meets at most
    HOT_HOMES homes. Anchors with more are cut into a grid of cells, compared block by block, and
    only a spanning forest of each cell's links leaves it. No link is lost either way. ``third``: whether anchors
    have a third codeword; by the number of groups if not given.
    """
    third = groups.count() > MANY if third is None else third
    spread = materialize(groups.mapInPandas(_replicate(third), "anchor long, fp long, rep long, is_home boolean"), "anchors")
    homes, probes = spread.where("is_home"), spread.where("NOT is_home")
    load = spread.groupBy("anchor").agg(F.count_if("is_home").alias("n"), F.count_if(~F.col("is_home")).alias("probes"))
    load = materialize(load.where("n > 0"), "loads")
    part = lambda n, of: F.greatest(F.ceil(F.col(n) / of), F.lit(1)).cast("int")
    hot = load.where(F.col("n") > HOT_HOMES).select("anchor", part("n", CELL).alias("down"), part("probes", PROBES).alias("across"))
    cold = load.where(F.col("n") <= HOT_HOMES).select("anchor")
    x = F.col("h.fp").bitwiseXOR(F.col("p.fp"))
    pairs = (
        homes.join(cold, "anchor", "left_semi")
        .alias("h")
        .join(probes.alias("p"), "anchor")
        .where((F.col("h.fp") < F.col("p.fp")) & (F.bit_count(x) <= THRESHOLD))
        .select(F.col("h.rep").alias("a"), F.col("p.rep").alias("b"))
    )
    # a home has its row and stands in every column, a replica the other way round
    of = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    grid = spread.join(hot, "anchor").withColumn("own", F.when(F.col("is_home"), of("down")).otherwise(of("across")))
    grid = grid.select("anchor", "fp", "rep", "is_home", "own", F.explode(F.sequence(F.lit(0), F.when(F.col("is_home"), F.col("across")).otherwise(F.col("down")) - 1)).alias("other"))
    cells = grid.select(
        "anchor",
        F.when(F.col("is_home"), F.col("own")).otherwise(F.col("other")).cast("long").alias("row"),
        F.when(F.col("is_home"), F.col("other")).otherwise(F.col("own")).cast("long").alias("col"),
        "fp",
        "rep",
        "is_home",
    )
    forest = cells.groupBy("anchor", "row", "col").applyInPandas(_cell_forest, "a long, b long")
    return pairs.unionByName(forest)


def _with_components(groups: DataFrame) -> DataFrame:
    """groups(fp, ...) with ``component``, the smallest fingerprint of its component: links go by fingerprints, which are never null."""
    since = scratch_tables()
    comp = materialize(connected_components(fingerprint_links(groups.select("fp", F.col("fp").alias("rep"))), "a", "b"), "components")
    drop_scratch(since, comp)
    return groups.join(comp, groups["fp"] == comp["node"], "left").select(*groups.columns, F.coalesce("component", "fp").alias("component"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fp, component_id).

    Documents link when their fingerprints differ in at most 2 bits; component_id is the smallest
    id reachable over links. Null, empty and wordless texts have fingerprint 0 and link with each
    other. Repeated rows stay rows and share a component. Rows with a null id link like any other;
    component_id is null only where no row of the component has an id. Very long texts are read whole,
    shingle block by shingle block. Ties don't arise: the smallest id counts. An empty table gives an
    empty table. Other columns of ``docs`` are not touched, whatever their names.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    named = _with_components(materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.join(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, that with the smallest id; same columns.

    Null ids come last, so a component without any id keeps a row too. Of rows with one id that with
    the smallest fingerprint stays, then that of the smallest text hash, then the first as read. Null, empty
    and wordless texts are near each other; repeated rows are. Very long texts are taken whole. An empty table
    gives an empty table.
    """

    @F.pandas_udf("long")
    def prints(text: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t) for t in text], dtype="int64")

    # written before use, so that the row numbers are the same each time they are read
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            prints(F.col(text_col)).alias("fp"),
            F.xxhash64(F.col(text_col)).alias("h"),
            F.monotonically_increasing_id().alias("at"),
            F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        ),
        "rows",
        TEXT_ROWS,
    )
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h", "at")
    named = _with_components(materialize(rows.groupBy("fp").agg(F.min(best).alias("best")), "fps"))
    keep = named.groupBy("component").agg(F.min("best").alias("best")).select("best.at")
    return rows.join(keep, "at", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
