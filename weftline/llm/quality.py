"""Quality classifier by co-training on two views of a document.

The text view is computed from the text alone: a hashed histogram of byte trigrams, repetition of words and
lines, shares of kinds of characters. The page view is the page's metadata alone: source, language, declared
length. One logistic regression a view is fitted on labelled documents. In each round either view scores all
other documents and hands some of those that it is sure of to the other view, and both are fitted again. At
the end each view is calibrated on labelled documents kept apart, and the calibrated log-odds are combined to
score every document.

Both views of all documents are computed once and written to a table. A fit uses at most LABELLED_ROWS
labelled documents; what the views are sure of is counted over all documents, and of it TAUGHT_ROWS a view
and class, chosen by hash from the whole table, are learned from in the last round (fewer in earlier ones).
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, drop_scratch, materialize, scratch_tables

LABELLED_ROWS = 8000
TAUGHT_ROWS = 1500
ROUNDS = 3
SURE = 0.95
ACCEPT = 0.5
TRIGRAMS = 256
TEXT_DIM = TRIGRAMS + 4 + 13
_SOURCES, _LANGS, _LENGTHS = 32, 8, 24
PAGE_DIM = 2 + _LENGTHS + _SOURCES + _LANGS
_CHUNK = 1 << 20
_KINDS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 symbol
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 1, 2, 3, 4, 5
_KINDS[[b for b in range(33, 127) if chr(b) not in ".,;:'\"" and not chr(b).isalnum()]] = 6


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed trigram shares, fading for short texts; repetition of words; layout and kinds of characters."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist, kinds = np.zeros(TRIGRAMS), np.zeros(7)
    for lo in range(0, len(raw), _CHUNK):
        b = raw[lo : lo + _CHUNK + 2].astype(np.uint32)
        kinds += np.bincount(_KINDS[raw[lo : lo + _CHUNK]], minlength=7)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(24)
        hist += np.bincount(h, minlength=TRIGRAMS)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    faded = len(raw) / (len(raw) + 64)
    same = sum(map(operator.eq, words, words[1:])) / n
    own = len(set(words)) / n
    solid = len(raw) - kinds[4] - kinds[5]
    out = np.empty(TEXT_DIM, np.float32)
    out[:TRIGRAMS] = np.sqrt(hist / max(hist.sum(), 1.0)) * faded
    out[TRIGRAMS:] = [
        own,
        same,
        np.sqrt(same),
        np.log1p(n) / 8 * (1 - own),
        *np.sqrt(kinds / max(len(raw), 1)),
        np.log1p(len(lines)) / 8,
        np.log1p(len(text) / len(lines)) / 8,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(raw)) / 16,
        min(solid / (kinds[4] + kinds[5] + 1), 40.0) / 10,
        0.0 if text else 1.0,
    ]
    return out


def page_view(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Declared length (itself and in half octaves), source and language."""
    out = np.zeros(PAGE_DIM, np.float32)
    if n_chars is not None and n_chars == n_chars:
        size = np.log1p(max(float(n_chars), 0.0))
        out[0] = size / 16
        out[2 + min(int(size * 2 / np.log(2)), _LENGTHS - 1)] = 1
    else:
        out[1] = 1
    out[2 + _LENGTHS + zlib.crc32(("s" + (source or "")).encode("utf-8", "surrogatepass")) % _SOURCES] = 1
    out[2 + _LENGTHS + _SOURCES + zlib.crc32(("l" + (lang or "")).encode("utf-8", "surrogatepass")) % _LANGS] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Model:
    """A weight vector and calibration (slope, intercept) a view; the share of good documents among the labels."""

    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, text_x: np.ndarray, page_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text probability, page probability, combined probability): views count as independent given the class."""
        z = [log_odds(x, w) * c[0] + c[1] for x, w, c in zip((text_x, page_x), self.views, self.calibration)]
        prior = np.log(self.prior / (1 - self.prior))
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(z[0] + z[1] - prior)


def fit_views(own: tuple[np.ndarray, np.ndarray], y: np.ndarray, taught: tuple[tuple[np.ndarray, np.ndarray], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both views from the labelled rows and the rows (x, labels) that the other view gave, at half the weight."""
    return tuple(
        fit_logistic(np.vstack([own[v], taught[v][0]]), np.concatenate([y, taught[v][1]]), np.concatenate([np.ones(len(y)), np.full(len(taught[v][1]), 0.5)])) for v in (0, 1)
    )


def calibrate(views: tuple[np.ndarray, np.ndarray], xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, prior: float) -> Model:
    found = []
    for x, w in zip(xs, views):
        z = log_odds(x, w)[:, None]
        c = fit_logistic(z, y, np.ones(len(z)), ridge=1e-2)
        found.append(c if c[0] > 0 else np.array([1.0, 0.0]))
    return Model(tuple(views), tuple(found), prior)


# ---------------------------------------------------------------- Spark
def _inputs(docs: DataFrame, text_col: str) -> list[Column]:
    has = set(docs.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    return [text, of("source", "string"), of("lang", "string"), of("n_chars", "double")]


def _packed(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
    """Both views of each row, 16 bits a number."""
    x = [text_view(t).astype(np.float16).tobytes() for t in text]
    m = [page_view(*r).astype(np.float16).tobytes() for r in zip(source, lang, n_chars)]
    return pd.DataFrame({"x": x, "m": m})


def _matrix(packed: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, packed)), np.float16).reshape(-1, dim).astype(np.float32)


def _matrices(x: pd.Series, m: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(x, TEXT_DIM), _matrix(m, PAGE_DIM)


def view_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of every row: i (its id), x and m (its views)."""
    views = F.pandas_udf(_packed, "struct<x:binary,m:binary>")
    t = docs.select(F.col(id_col).cast("long").alias("i"), views(*_inputs(docs, text_col)).alias("v"))
    return materialize(t.select("i", "v.x", "v.m"), "views", TEXT_ROWS)


def _scores(views: tuple[np.ndarray, np.ndarray]) -> Column:
    @F.pandas_udf("struct<z0:double,z1:double>")
    def run(x: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({f"z{v}": log_odds(a, w) for v, (a, w) in enumerate(zip(_matrices(x, m), views))})

    return run("x", "m")


def _taught(pool: DataFrame, views: tuple[np.ndarray, np.ndarray], most: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For either view, up to about ``most`` rows a class that the other one is sure of, by hash out of all that it is sure of."""
    least = float(np.log(SURE / (1 - SURE)))
    rows = pool.select("i", "x", "m", _scores(views).alias("z")).select(
        "i", "x", "m", F.inline(F.array(F.struct(F.lit(1).alias("v"), F.col("z.z0").alias("z")), F.struct(F.lit(0).alias("v"), F.col("z.z1").alias("z"))))
    )
    sure = rows.where(F.abs("z") >= least).withColumn("y", (F.col("z") > 0).cast("int"))
    count = {(r["v"], r["y"]): r["n"] for r in sure.groupBy("v", "y").agg(F.count("*").alias("n")).collect()}
    none = tuple((np.zeros((0, d), np.float32), np.zeros(0)) for d in (TEXT_DIM, PAGE_DIM))
    if not count:
        return none
    share = F.create_map(*[F.lit(e) for (v, y), n in count.items() for e in (2 * v + y, n / most)])
    u = F.pmod(F.xxhash64("i", "x", "m", F.lit(18)), F.lit(1 << 40)) / float(1 << 40)
    rank = u * F.element_at(share, 2 * F.col("v") + F.col("y"))
    # the limit bounds what the driver gets where one row repeats very often
    got = sure.withColumn("rank", rank).where("rank < 1").orderBy("rank", "i", "v").limit(5 * most).select("x", "m", "v", "y").toPandas()
    return tuple((_matrices(g["x"], g["m"])[v], g["y"].to_numpy(float)) if len(g := got[got["v"] == v]) else none[v] for v in (0, 1))


def fit_table(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, taught_rows: int = TAUGHT_ROWS, rounds: int = ROUNDS) -> Model | None:
    """fit() on a view_table()."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("i").agg(F.max("y").alias("y")).join(table.select("i").distinct(), "i", "left_semi")
    chosen = materialize(known.orderBy(F.xxhash64(F.col("i"), F.lit(17)), "i").limit(labelled_rows), "labelled")
    # of the rows of one id, one takes part; at most labelled_rows rows of two numbers are broadcast
    rows = table.select("i", "x", "m").join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min_by(F.struct("x", "m"), F.xxhash64("x", "m")).alias("v"))
    got = rows.select("i", "y", "v.x", "v.m").toPandas()
    got = got.assign(h=[zlib.crc32(str(i).encode()) for i in got["i"]]).sort_values(["h", "i"])
    y = got["y"].to_numpy(float)
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return None
    xs = _matrices(got["x"], got["m"])
    apart = np.arange(len(y)) % 5 == 4  # rows are in hash order
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    own = tuple(x[~apart] for x in xs)
    pool = table.select("i", "x", "m").join(F.broadcast(chosen.select("i")), "i", "left_anti")
    none = tuple((np.zeros((0, x.shape[1]), np.float32), np.zeros(0)) for x in xs)
    views = fit_views(own, y[~apart], none)
    for k in range(rounds):
        views = fit_views(own, y[~apart], _taught(pool, views, max(1, taught_rows * (k + 1) // rounds)))
    held = apart if apart.any() else np.ones(len(y), bool)
    return calibrate(views, tuple(x[held] for x in xs), y[held], float(np.clip(y.mean(), 0.01, 0.99)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, taught_rows: int = TAUGHT_ROWS, rounds: int = ROUNDS) -> Model | None:
    """Fit on at most ``labelled_rows`` labelled documents and on what the views teach each other about all others.

    Labels other than 0 and 1 (null among them) are passed over; of contradicting labels of one document the
    larger counts; of several rows of one labelled id, one takes part, chosen by its content. Returns None if
    the sample has less than ten rows or lacks a class.
    """
    since = scratch_tables()
    model = fit_table(view_table(docs, id_col, text_col), labels, id_col, label_col, labelled_rows, taught_rows, rounds)
    drop_scratch(since)
    return model


def _probabilities(model: Model, x: pd.Series, m: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(np.stack(model.score(*_matrices(x, m)), axis=1), columns=["text", "page", "score"])


def _scored(model: Model) -> Column:
    """Struct (text, page, score) of probabilities of a view_table()'s row."""

    @F.pandas_udf("struct<text:double,page:double,score:double>")
    def run(x: pd.Series, m: pd.Series) -> pd.DataFrame:
        return _probabilities(model, x, m)

    return run("x", "m")


def probabilities(model: Model, docs: DataFrame, text_col: str = "text") -> Column:
    """Struct (text, page, score) of a document's probabilities of good quality."""

    @F.pandas_udf("struct<text:double,page:double,score:double>")
    def run(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        v = _packed(text, source, lang, n_chars)
        return _probabilities(model, v["x"], v["m"])

    return run(*_inputs(docs, text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, p_text, p_page, score, kept (score >= 0.5).

    Null texts count as empty; very long texts are read whole; missing metadata counts as its own value. Ties
    don't arise: every row is scored by itself, repeated rows alike, null ids too. Other columns don't matter,
    whatever their names. Without labels of both classes nothing can be learned: probabilities are null and
    every row is kept. An empty table gives an empty table.
    """
    table = view_table(docs, id_col, text_col)
    model = fit_table(table, labels, id_col)
    if model is None:
        none = F.lit(None).cast("double")
        return table.select(F.col("i").alias("doc_id"), none.alias("p_text"), none.alias("p_page"), none.alias("score"), F.lit(True).alias("kept"))
    scored = table.select(F.col("i").alias("doc_id"), _scored(model).alias("p"))
    return scored.select("doc_id", F.col("p.text").alias("p_text"), F.col("p.page").alias("p_page"), F.col("p.score").alias("score"), (F.col("p.score") >= ACCEPT).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that classify() keeps; same columns. Cases are those of classify(). ``model``: one that is fitted already."""
    model = model or fit(docs, labels, id_col, text_col)
    return docs if model is None else docs.where(probabilities(model, docs, text_col)["score"] >= ACCEPT)
