"""Token counts by rank-synchronous merging.

Pre-tokens of a batch are ragged numpy arrays of symbol ids. In every round each sequence finds its
lowest-ranked adjacent pair, all sequences merge their pair at once (every occurrence, from the left,
without overlap), and sequences without a mergeable pair drop out. The surviving symbols are counted.

Long sequences keep their pairs by rank, so a round touches only the places where its pair occurs and their
neighbours: the time is linear in the word's length, however long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textwords, wordbpe

MAX_TOKENS = 2048
CACHE_CHUNKS = 1_800_000
_NO_RANK = np.iinfo(np.int64).max


#: Sequences of more symbols than this count as long.
LONG = 128


def _pairs(bpe: wordbpe.WordBPE, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each pair of symbols, the symbol it merges to); _NO_RANK for pairs that don't merge."""
    keys, ranks, to = bpe.merge_tables
    pair = left * len(bpe.strings) + right
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    return np.where(keys[at] == pair, ranks[at], _NO_RANK), to[at]


def _surviving_long(bpe: wordbpe.WordBPE, sym: np.ndarray, off: np.ndarray) -> np.ndarray:
    """surviving() for long sequences: symbols ``sym`` with offsets ``off``."""
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[off[1:] - 1] = n  # a sequence's last symbol has none behind it, its first none before it
    before[off[:-1]] = -1
    sym = np.append(sym, 0)
    rank = np.full(n + 1, _NO_RANK)
    buckets: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look(places: np.ndarray) -> None:
        """Rank the pairs that begin at these places anew."""
        inner = places[after[places] < n]
        rank[places] = _NO_RANK
        rank[inner], _ = _pairs(bpe, sym[inner], sym[after[inner]])
        inner = inner[rank[inner] != _NO_RANK]
        if not len(inner):
            return
        inner = inner[np.argsort(rank[inner], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[inner])) + 1
        for part in np.split(inner, cut):
            r = int(rank[part[0]])
            if r not in buckets:
                buckets[r] = []
                heapq.heappush(heap, r)
            buckets[r].append(part)

    look(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        places = np.unique(np.concatenate(buckets.pop(r)))
        places = places[rank[places] == r]
        if not len(places):
            continue
        fresh = np.append(True, after[places[:-1]] != places[1:])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - lead) % 2 == 0]
        gone = after[places]
        _, sym[places] = _pairs(bpe, sym[places], sym[gone])
        rank[gone] = _NO_RANK
        sym[gone] = -1
        behind = after[gone]
        after[places] = behind
        there = behind < n
        before[behind[there]] = places[there]
        left = before[places]
        look(np.unique(np.concatenate([places, left[left >= 0]])))
    return np.add.reduceat(sym[:n] >= 0, off[:-1], dtype=np.int64)


def surviving(bpe: wordbpe.WordBPE, words: list[bytes]) -> np.ndarray:
    """Number of symbols that each word has after all merges."""
    sym, off = bpe.symbols(words)
    out = np.diff(off)
    far = out > LONG
    if far.any():
        size = out[far]
        out[far] = _surviving_long(bpe, sym[np.repeat(far, out)], np.append(0, np.cumsum(size)))
        out[~far] = surviving(bpe, [w for w in words if len(w) <= LONG])
        return out
    alive = np.flatnonzero(out > 1)
    keep = np.repeat(out > 1, out)
    sym = sym[keep]
    size = out[alive]
    while len(alive):
        off = np.concatenate([[0], np.cumsum(size)])
        starts, ends = off[:-1], off[1:] - 1
        rank, to = _pairs(bpe, sym, np.append(sym[1:], 0))
        rank[ends] = _NO_RANK
        low = np.minimum.reduceat(rank, starts)
        hit = (rank == np.repeat(low, size)) & (rank != _NO_RANK)
        # occurrences that follow each other overlap: of a run take every second, from its first
        idx = np.flatnonzero(hit)
        if len(idx):
            fresh = np.r_[True, idx[1:] != idx[:-1] + 1]
            first = idx[np.maximum.accumulate(np.where(fresh, np.arange(len(idx)), 0))]
            idx = idx[(idx - first) % 2 == 0]
        sym[idx] = to[idx]
        gone = np.zeros(len(sym), bool)
        gone[idx + 1] = True
        merged = np.add.reduceat(gone, starts)
        size = size - merged
        sym = sym[~gone]
        done = (low == _NO_RANK) | (size == 1)
        out[alive[done]] = size[done]
        sym = sym[np.repeat(~done, size)]
        alive, size = alive[~done], size[~done]
    return out


class _Counter:
    """Token counts of texts by way of the counts of their distinct words."""

    def __init__(self, path: str):
        self.bpe = wordbpe.load(path)
        self.words = textwords.TextWords(self.bpe, self._learn, self._forget, CACHE_CHUNKS)

    def _forget(self) -> None:
        self.counts, self.used = np.zeros(1 << 15, np.int32), 0

    def _learn(self, words: list[bytes]) -> None:
        n = self.used + len(words)
        if n > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(n, np.int32)])
        self.counts[self.used : n] = surviving(self.bpe, words)
        self.used = n

    def one(self, text: str) -> int:
        chunks = self.bpe.text_chunks(text)
        special = sum(c in self.bpe.special for c in chunks)
        return special + int(surviving(self.bpe, [w for c in chunks if c not in self.bpe.special for w in self.bpe.pretokens(c)]).sum())

    def count(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for run, numbers, bounds, other in self.words.find(texts):
            total = np.append(0, np.cumsum(self.counts[numbers], dtype=np.int64))
            n = np.diff(total[bounds])
            for k in other:
                n[k] = self.one(run[k].as_py())
            out.append(n)
        return np.concatenate(out)


@lru_cache(maxsize=2)
def _counter(path: str) -> _Counter:
    return _Counter(path)


def count_tokens(texts: list[str], path: str) -> list[int]:
    return _counter(path).count(pa.array(texts, pa.string())).tolist()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > max_tokens).

    Null text counts as empty, which has 0 bytes and tokens. Very long texts and words are counted whole, in
    linear time. Special strings inside texts count as one token each. Ties don't arise: each row is counted
    by itself, repeated rows and null ids too. Other columns don't matter, whatever their names. An empty table
    gives an empty table. ``path`` is the vocabulary file on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.count(batch.column(2)))], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
