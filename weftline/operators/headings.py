"""Near-duplicate headings of any number of documents, folded by the merge rule."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import session
from . import hamming
from .merge_fold import _STOP

@lru_cache(maxsize=1 << 16)
def _word_bits(word: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[8:], np.uint8))


def fingerprint(text: str | None) -> int:
    """merge_fold.simhash as a signed long, with the words' hashes kept."""
    words = [w for w in re.sub(r"[^\w\s]", "", (text or "").lower()).split() if w not in _STOP]
    ones = np.zeros(64, np.int64)
    for w in words:
        ones += _word_bits(w)
    return int(np.packbits(2 * ones > len(words)).view(">i8")[0])


class Kept:
    """What fuzzy_dedup keeps, from texts' fingerprints and lengths, which come in order; ``line`` numbers the texts."""

    def __init__(self) -> None:
        self.n = 0
        self.fp, self.size, self.line = np.zeros(8, np.uint64), np.zeros(8, np.int64), np.zeros(8, np.int64)

    def take(self, prints: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> None:
        for x, length, line in zip(prints.view(np.uint64), sizes.tolist(), lines.tolist()):
            # many lines are near one of the first: blocks of growing size
            near, lo, step = -1, 0, 256
            while near < 0 and lo < self.n:
                found = np.bitwise_count(self.fp[lo : min(self.n, lo + step)] ^ x) <= C.SIMHASH_DISTANCE
                if found[first := int(found.argmax())]:
                    near = lo + first
                lo, step = lo + step, 4 * step
            if near < 0:
                near, self.n = self.n, self.n + 1
                if self.n > len(self.fp):
                    self.fp, self.size, self.line = (np.concatenate([a, np.zeros_like(a)]) for a in (self.fp, self.size, self.line))
            elif length <= self.size[near]:
                continue
            self.fp[near], self.size[near], self.line[near] = x, length, line

    def lines(self) -> np.ndarray:
        return self.line[: self.n]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (g, component, o, r); of the component at hand no more is held than what is kept."""
    now, at = Kept(), None
    for pdf in batches:
        if not len(pdf):
            continue
        g, component = pdf["g"].to_numpy(), pdf["component"].to_numpy()
        begins = np.append(True, (g[1:] != g[:-1]) | (component[1:] != component[:-1]))
        edges = [*np.flatnonzero(begins).tolist(), len(pdf)]
        columns, done = [pdf[c].to_numpy() for c in ("fp", "size", "line")], []
        for lo, hi in zip(edges, edges[1:]):
            if at != (key := (g[lo], component[lo])):
                done.append(now.lines())
                now, at = Kept(), key
            now.take(*[c[lo:hi] for c in columns])
        yield pd.DataFrame({"line": np.concatenate(done)} if done else {"line": np.zeros(0, np.int64)})
    yield pd.DataFrame({"line": now.lines()})


def fold(lines: DataFrame) -> DataFrame:
    """(source, heading): what fuzzy_dedup keeps of each source's lines(source, doc_id, t), in order of doc_id, then of the line.

    Repeats of a line within a source count once, at their first document (null ids come first). The
    fold lets only lines within the distance meet, so it is exact on each connected component of
    such links: a component of one fingerprint keeps its longest line by an aggregate, any other is
    folded in order. A component goes through one task in
    order, which holds three numbers of each line that it keeps of it so far, and no text.
    """
    session.checkpoints(lines.sparkSession)

    @F.pandas_udf("long")
    def prints(t: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x) for x in t], dtype="int64")

    keyed = lines.select("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("o"), "t")
    first = keyed.groupBy("g", "source", "t").agg(F.min("o").alias("o")).withColumn("fp", prints("t")).withColumn("node", F.xxhash64("g", "fp")).checkpoint()
    # hashes that clash only join components, and the fold of joined components is the same
    every = hamming.connect(first.select("g", "fp", "node").distinct(), C.SIMHASH_DISTANCE)
    found = every.join(every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component").select("node", "component")
    alone = first.join(found, "node", "left_anti").groupBy("g", "source", "fp").agg(F.min(F.struct((-F.char_length(F.coalesce("t", F.lit("")))).alias("n"), "o", "t")).alias("x"))

    # lines of one id are ranked by their texts here, so that the fold needs no text
    ranked = F.row_number().over(Window.partitionBy("g", "o").orderBy("t"))
    linked = first.join(found, "node").withColumn("r", ranked).withColumn("line", F.monotonically_increasing_id()).checkpoint()
    numbers = linked.select("g", "component", "o", "r", "fp", "line", F.char_length(F.coalesce("t", F.lit(""))).alias("size"))
    ordered = numbers.repartition("g", "component").sortWithinPartitions("g", "component", "o", "r")
    lasting = ordered.select("g", "component", "fp", "size", "line").mapInPandas(_fold, "line long")
    folded = linked.join(lasting, "line", "left_semi").select("source", F.col("t").alias("heading"))
    return alone.select("source", F.col("x.t").alias("heading")).unionByName(folded)
