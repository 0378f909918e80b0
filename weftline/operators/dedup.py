"""SimHash fingerprints of words and the classes of documents that they link."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import session
from . import hamming

_STOP = frozenset(C.SIMHASH_STOPWORDS)
#: Words whose hashes are summed in one go.
_WORDS = 1 << 18


def fingerprints(words: list[np.ndarray]) -> np.ndarray:
    """64-bit fingerprints of lists of words: a bit is set if more words (repeats count) have it in their hash than not. No words: 0."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - sizes[lo] + _WORDS, "right")))
        some = lo + np.flatnonzero(sizes[lo:hi])
        if len(some):
            codes, distinct = pd.factorize(np.concatenate([words[k] for k in some]))
            low = b"".join([hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[8:] for w in distinct])
            bits = np.unpackbits(np.frombuffer(low, np.uint8).reshape(-1, 8), axis=1)
            if len(some) == 1:  # however long the text: once a distinct word
                ones = (np.bincount(codes, minlength=len(distinct)) @ bits.astype(np.int64))[None]
            else:
                ones = np.add.reduceat(bits[codes], np.cumsum(sizes[some]) - sizes[some], axis=0, dtype=np.int64)
            out[some] = np.packbits(2 * ones > sizes[some][:, None], axis=1).view(">i8")[:, 0]
        lo = hi
    return out


def _words(t: str | None) -> np.ndarray:
    return np.array([w for w in re.sub(r"[^\w\s]", "", (t or "").lower()).split() if w not in _STOP], object)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row: the fingerprint of its words, from the row alone."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([_words(t) for t in texts]), dtype="int64")

    return docs.select(F.col(id_col), prints(text_col).alias("fp"))


def near_classes(fps: DataFrame, id_col: str = "doc_id", distance: int = C.SIMHASH_DISTANCE) -> DataFrame:
    """(id, rep, component) of every row of fps(id, fp): the smallest id with the same fingerprint, and the smallest that
    links of at most ``distance`` bits lead to."""
    session.checkpoints(fps.sparkSession)
    fps = fps.checkpoint()  # texts are read once
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("rep")).checkpoint()
    found = hamming.connect(classes.select(F.lit("").alias("g"), F.col("rep").alias("node"), "fp"), distance)
    named = classes.join(found, classes["rep"] == found["node"]).select("fp", "rep", "component")
    return fps.join(named, "fp").select(id_col, "rep", "component")
