"""A hidden Markov language model, trained by Baum-Welch over all training documents.

A hidden state emits a class of words, and the class a word. A word that makes up at least 1/HEAD of the training
tokens is a class of its own, as is the end of a text; the others fall into FORMS classes by their form (last two
characters, first one, digits alike), so words never seen have a class too. Within a class of forms a word's
probability is add-one over the class, one share going to all words unseen:

    P(text) = sum over state paths of prod P(state | state before) P(class | state) * prod P(word | class)

Words' counts are a distributed table and grow with the corpus. States, transitions and class emissions are bounded
by parameters. Texts become runs of class numbers once: segments number their words by dictionaries of their own,
the dictionaries' words meet the counts by a join, and what comes back are numbers by segment.

* Start: windows of WINDOW tokens go to states by the signs of random projections of their classes.
* Baum-Welch: scaled forward and backward passes over windows of all training texts. A text's first window starts
  from the start distribution, the others from the states' overall frequencies. Tasks sum expected counts as
  integers (units of 2^-20), so sums don't depend on their order; a round collects one bounded matrix.
* Scoring is exact for texts of any length: a window is the matrix of scaled forward passes from each state, and a
  text's windows are multiplied in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments
from .common import batches_of, drop_scratch, materialize, scratch_tables

HEAD, FORMS = 4096, 2048
BITS = 3
STATES = 1 << BITS
ROUNDS = 3
WINDOW = 128
#: Windows that are passed through together: what they need stays inside the cache.
LANES = 1024
#: Weight of the overall class frequencies in a state's emissions, and of one more transition, in tokens.
PRIOR, EXTRA = 50.0, 0.5
UNIT = float(1 << 20)
HELD_OUT = 2
SEGMENT_ROWS = 2500
#: Words of dictionaries that are packed together on their way to the segments.
PACK = 1 << 19
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False

_ENCODED = pa.schema([("segment", pa.int64()), ("word", pa.string()), ("idx", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_PACKED = pa.schema([("at", pa.int64()), ("idx", pa.binary()), ("c", pa.binary()), ("cls", pa.binary())])
_DOCS = "ids binary, known binary, held binary, sizes binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's words, each with its occurrences in training documents, and one row of its texts as word numbers, common words first, in two planes."""
    for segment, rows in segments.pieces(batches, "text"):
        vocabulary, word, doc = segments.words(rows.column("text"), _INSIDE)
        held = rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
        k, ids = len(vocabulary), rows.column("doc_id")
        order = np.argsort(-np.bincount(word, minlength=k), kind="stable")
        number = np.empty(k, np.int32)
        number[order] = np.arange(k)
        vocabulary, word = vocabulary.take(pa.array(order)), number[word]
        n = np.bincount(word[~held[doc]], minlength=k)
        none = pa.nulls(k, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(segment, pa.int64()), k), vocabulary, pa.array(np.arange(k, dtype=np.int32)), pa.array(n.astype(np.int64)), *[none] * 6], schema=_ENCODED)
        sizes = np.bincount(doc, minlength=len(ids)).astype("<i4")
        own = [segment, None, None, None, ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), held.tobytes(), sizes.tobytes(), word.astype("<u2").tobytes(), (word >> 16).astype(np.uint8).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(own, _ENCODED)], schema=_ENCODED)


def form(word: Column, first: int) -> Column:
    """The class of a word by its form; classes of forms are numbered from ``first`` on."""
    w = F.translate(word, "0123456789", "0000000000")
    return (F.pmod(F.xxhash64(F.concat_ws("\x01", F.substring(w, 1, 1), F.substring(w, -2, 2))), F.lit(FORMS)) + first).cast("int")


class Words:
    """Counts of the training words: ``counts`` (word, c, cls); totals and the classes' own totals."""

    def __init__(self, encoded: DataFrame, n_docs: int):
        seen = materialize(encoded.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "words")
        s = seen.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
        self.tokens, self.types = (s["c"] or 0) + n_docs, s["v"] + (n_docs > 0)
        head = seen.where(F.col("c") * HEAD >= self.tokens).orderBy(F.desc("c"), "word").limit(HEAD).collect()
        self.first = len(head) + 1  # class 0 is the end of a text
        self.classes = self.first + FORMS
        known = encoded.sparkSession.createDataFrame([(r["word"], k + 1) for k, r in enumerate(head)], "word string, own int")
        classed = seen.join(F.broadcast(known), "word", "left").withColumn("cls", F.coalesce("own", form(F.col("word"), self.first))).select("word", "c", "cls")
        self.counts = materialize(classed, "counts")
        self.n, self.v = np.zeros(self.classes, np.int64), np.zeros(self.classes, np.int64)
        self.n[0] = n_docs
        for r in self.counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # one row a class
            self.n[r["cls"]], self.v[r["cls"]] = r["c"], r["v"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, idx, c, cls) as arrays by segment, so that they travel as few rows."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        at, idx, c, cls = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in _PACKED.names)
        order = np.lexsort((idx, at))
        at = at[order]
        first = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
        cols = [segments.binaries(x[order].astype(kind), first) for x, kind in ((idx, "<i4"), (c, "<i8"), (cls, "<u2"))]
        return pa.RecordBatch.from_arrays([pa.array(at[first[:-1]]), *cols], schema=_PACKED)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= PACK:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


def _classed(first: int, n: np.ndarray, v: np.ndarray, tokens: int, types: int, n_docs: int):
    """A segment's texts as runs of classes, each ended by class 0; a text's base score, known tokens and log10 of its words given their classes."""
    rest = np.log10((n + v + 1).astype(float))

    def run(key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        r = texts.iloc[0]
        idx, n_, cls_ = (np.frombuffer(b"".join(words[k]), kind) for k, kind in (("idx", "<i4"), ("c", "<i8"), ("cls", "<u2")))
        k = len(idx)
        c, cls = np.zeros(k, np.int64), np.zeros(k, np.int64)
        c[idx], cls[idx] = n_, cls_
        word = np.frombuffer(r["low"], "<u2").astype(np.int32) + (np.frombuffer(r["high"], np.uint8).astype(np.int32) << 16)
        sizes = np.frombuffer(r["sizes"], "<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda x: np.bincount(doc, weights=x[word], minlength=len(sizes))
        log = np.log10(c + 1.0)
        base = sums(log) + np.log10(n_docs + 1.0) - (sizes + 1) * np.log10(tokens + types + 1.0)
        inner = sums(np.where(cls >= first, log - rest[cls], 0.0)) if k else np.zeros(len(sizes))
        known = sums((c > 0).astype(float)).astype(np.int64) + (n_docs > 0)
        ends = np.cumsum(sizes + 1) - 1
        run_ = np.zeros(len(word) + len(sizes), "<u2")
        run_[np.arange(len(word)) + doc] = cls[word]
        run_[ends] = 0
        row = [key[0], r["ids"], r["known"], r["held"], (sizes + 1).astype("<i4").tobytes(), run_.tobytes(), base.tobytes(), inner.tobytes(), known.tobytes()]
        return pd.DataFrame([row], columns=["segment", "ids", "known", "held", "sizes", "run", "base", "inner", "hits"])

    return run


_CLASSED = f"segment long, {_DOCS}, run binary, base binary, inner binary, hits binary"


class Model:
    """start (STATES), move (STATES, STATES), emit (classes, STATES), and the states' overall frequencies."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        share = emit.sum(axis=1)
        share = (share + 1.0) / (share.sum() + len(share))
        self.emit = (emit + PRIOR * share[:, None]) / (emit.sum(axis=0) + PRIOR)
        self.move = (move + EXTRA) / (move + EXTRA).sum(axis=1, keepdims=True)
        self.start = (start + EXTRA) / (start + EXTRA).sum()
        self.overall = (emit.sum(axis=0) + EXTRA) / (emit.sum() + EXTRA * emit.shape[1])


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each window of a concatenation of texts begins, its length, whether it is its text's first)."""
    many = -(-sizes // WINDOW)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(np.cumsum(sizes) - sizes, many) + at * WINDOW
    return begin, np.minimum(WINDOW, np.repeat(sizes, many) - at * WINDOW), at == 0


def _lanes(run: np.ndarray, begin: np.ndarray, long: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of windows, longest first: (which, classes by step and lane, lanes alive at each step)."""
    order = np.argsort(-long, kind="stable")
    for lo in range(0, len(order), LANES):
        which = order[lo : lo + LANES]
        n = long[which]
        steps = np.arange(n[0])
        at = np.minimum(begin[which][None, :] + steps[:, None], len(run) - 1)
        yield which, run[at], (n[None, :] > steps[:, None]).sum(axis=1)


def expected(model: Model, run: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (starts, moves, emissions) over the windows of texts."""
    states, classes = len(model.start), len(model.emit)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    begin, long, first = windows(sizes)
    for which, cls, alive in _lanes(run, begin, long):
        steps = len(alive)
        b = model.emit[cls]
        alpha, scale = np.zeros_like(b), np.ones(cls.shape)
        a = np.where(first[which][:, None], model.start, model.overall)
        for t in range(steps):
            m = alive[t]
            a = (a if t == 0 else a[:m] @ model.move) * b[t, :m]
            s = a.sum(axis=1)
            a /= s[:, None]
            alpha[t, :m], scale[t, :m] = a, s
        beta = np.ones((len(which), states))
        for t in range(steps - 1, 0, -1):
            m = alive[t]
            after = b[t, :m] * beta[:m] / scale[t, :m, None]
            move += alpha[t - 1, :m].T @ after
            alpha[t, :m] *= beta[:m]  # the states' probabilities at t
            beta[:m] = after @ model.move.T
        alpha[0] *= beta
        start += alpha[0][first[which]].sum(axis=0)
        live = np.arange(len(which))[None, :] < alive[:, None]
        c, g = cls[live], alpha[live]
        for k in range(states):
            emit[k] += np.bincount(c, weights=g[:, k], minlength=classes)
    return start, move * model.move, emit.T


def guessed(planes: np.ndarray, run: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts with each window in one state, by the signs of its classes' summed projections ``planes`` (classes, BITS)."""
    begin, long, first = windows(sizes)
    classes, states = len(planes), 1 << planes.shape[1]
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    if len(begin):
        state = (np.add.reduceat(planes[run], begin) > 0) @ (1 << np.arange(planes.shape[1]))
        start += np.bincount(state[first], minlength=states)
        np.add.at(move, (state, state), long - 1)
        np.add.at(move, (state[:-1][~first[1:]], state[1:][~first[1:]]), 1)
        emit += np.bincount(run.astype(np.int64) * states + np.repeat(state, long), minlength=classes * states).reshape(classes, states)
    return start, move, emit


def _counted(count, classes: int):
    """A task's counts as rows (kind, id, n): kind 0 starts, 1 moves, 2 emissions; in units of 1 / UNIT."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for r in pdf.itertuples():
                sizes, learns = np.frombuffer(r.sizes, "<i4").astype(np.int64), ~np.frombuffer(r.held, bool)
                cls = np.frombuffer(r.run, "<u2")[np.repeat(learns, sizes)]
                got = count(cls, sizes[learns])
                total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is None:
            return
        for kind, x in enumerate((total[0][None], total[1], total[2])):
            rows = np.flatnonzero(x.any(axis=1))
            yield pd.DataFrame({"kind": kind, "id": rows} | {f"n{k}": np.rint(x[rows, k] * UNIT).astype(np.int64) for k in range(STATES)})

    return run


def _train(classed: DataFrame, count, classes: int) -> Model:
    """One pass over all training texts and the model of its counts; what is collected is bounded by classes and states."""
    cols = [f"n{k}" for k in range(STATES)]
    rows = classed.select("held", "sizes", "run").mapInPandas(_counted(count, classes), "kind int, id long, " + ", ".join(f"{c} long" for c in cols))
    with batches_of(classed.sparkSession, 1):  # a row is a segment
        got = rows.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    parts = [np.zeros((1, STATES)), np.zeros((STATES, STATES)), np.zeros((classes, STATES))]
    for r in got:
        parts[r["kind"]][r["id"]] = [r[c] / UNIT for c in cols]
    return Model(parts[0][0], parts[1], parts[2])


def _forward(model: Model, run: np.ndarray, begin: np.ndarray, long: np.ndarray, head: bool) -> tuple[np.ndarray, np.ndarray]:
    """(matrices, log10 scales): scaled forward passes over windows, from the start (``head``: one row) or from each state."""
    states = len(model.start)
    rows = 1 if head else states
    out, logs = np.zeros((len(begin), rows, states)), np.zeros(len(begin))
    for which, cls, alive in _lanes(run, begin, long):
        x = np.tile(model.start[None, None] if head else np.eye(states)[None], (len(which), 1, 1))
        log = np.zeros(len(which))
        for t, m in enumerate(alive.tolist()):
            y = x[:m] if head and t == 0 else (x[:m].reshape(-1, states) @ model.move).reshape(m, rows, states)
            y = y * model.emit[cls[t, :m]][:, None, :]
            if t % 8 == 7:
                s = y.sum(axis=(1, 2))
                y /= s[:, None, None]
                log[:m] += np.log10(s)
            x[:m] = y
        s = x.sum(axis=(1, 2))
        out[which], logs[which] = x / s[:, None, None], log + np.log10(s)
    return out, logs


def likelihoods(model: Model, run: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probabilities of texts of ``sizes`` classes each, one behind the other in ``run``."""
    begin, long, first = windows(sizes)
    many = -(-sizes // WINDOW)
    v, total = _forward(model, run, begin[first], long[first], True)
    v = v[:, 0]
    rest, logs = _forward(model, run, begin[~first], long[~first], False)
    at = np.cumsum(many - 1) - (many - 1)  # a text's first row among the rest
    r, live = 0, np.flatnonzero(many > 1)
    while len(live):
        k = at[live] + r
        now = np.einsum("ni,nij->nj", v[live], rest[k])
        s = now.sum(axis=1)
        v[live] = now / s[:, None]
        total[live] += logs[k] + np.log10(s)
        r += 1
        live = live[many[live] > r + 1]
    return total  # what is left of v sums to 1


def _scored(model: Model, tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                sizes = np.frombuffer(r.sizes, "<i4").astype(np.int64)
                score = likelihoods(model, np.frombuffer(r.run, "<u2"), sizes) + np.frombuffer(r.inner, "<f8")
                ids = pd.arrays.IntegerArray(np.frombuffer(r.ids, "<i8").copy(), ~np.frombuffer(r.known, bool))
                yield pd.DataFrame({"doc_id": ids, "held_out": np.frombuffer(r.held, bool), "n_tokens": sizes, "n_known": np.frombuffer(r.hits, "<i8"), "train_tokens": tokens, "base_score": np.frombuffer(r.base, "<f8"), "score": score})

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Trains on all documents whose crc32 of the id as text has a remainder by 7 other than HELD_OUT, and scores every
    whole text. A null or empty text is its end alone. Null ids: such documents train and are scored, doc_id null.
    Repeated rows and ids are documents of their own. Without any training document the base score is 0 and all
    classes are alike. There are no ties to break: heads of equal counts go by word. Texts of any length are taken
    whole. An empty table gives an empty table. Other columns don't matter, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_docs = rows.select("held").where("NOT held").count()
    since = scratch_tables()
    encoded = materialize(rows.mapInArrow(_encode, "segment long, word string, idx int, n long, ids binary, known binary, held binary, sizes binary, low binary, high binary"), "encoded", batch_rows=SEGMENT_ROWS)
    words = Words(encoded.where("word IS NOT NULL").select("word", "n"), n_docs)
    local = encoded.where("word IS NOT NULL").select("segment", "idx", "word")
    local = local.join(words.counts, "word", "left").select(F.col("segment").alias("at"), "idx", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("cls", form(F.col("word"), words.first)).alias("cls"))
    local = local.mapInArrow(_packed, "at long, idx binary, c binary, cls binary")
    texts = encoded.where("word IS NULL").select("segment", "ids", "known", "held", "sizes", "low", "high")
    merge = _classed(words.first, words.n, words.v, words.tokens, words.types, n_docs)
    classed = materialize(texts.groupBy("segment").cogroup(local.groupBy("at")).applyInPandas(merge, _CLASSED), "classed")
    drop_scratch(since, classed)
    share = words.n / max(1, words.n.sum())
    planes = np.random.default_rng(20_250_607).normal(size=(words.classes, BITS))
    planes -= share @ planes
    model = _train(classed, lambda cls, sizes: guessed(planes, cls, sizes), words.classes)
    for _ in range(ROUNDS):
        model = _train(classed, lambda cls, sizes, m=model: expected(m, cls, sizes), words.classes)
    out = classed.mapInPandas(_scored(model, words.tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = materialize(out, "scores", batch_rows=1)
    drop_scratch(since, out)
    return out
