"""Lexical search, the language model and hard negatives against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lexical, markov, negatives
from weftline.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---------------------------------------------------------------- lexical search
def ranked(docs, items):
    term = re.compile(lexical.TERM)
    bags = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(term.findall(lower(text)))
        scores = []
        for i, b in bags:
            n = sum(b.values())
            s = 0
            for t, k in asked.items():
                if b[t]:
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    s += k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[: lexical.TOP])]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["naïve", "漢字", "x9", "İ", "Q"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    texts = [r.choice([" ", "-", "\n", "."]).join(r.choices(vocab, weights, k=r.choice([1, 2, 5, 30, 120]))) for _ in range(n)]
    return texts, r


def test_lexical_search(spark):
    texts, r = corpus(3, 700)
    texts += [None, "", " .,- \n", "w1 " * 30_000, "W1 w2 W3"] + ["w1 w2 w3 w4"] * 40 + [texts[0]] * 3
    ids = [*range(1000, 1000 + len(texts) - 6), None, None, 7, 7, 7, -1]
    items = [(0, "w1 w2 w2 w9"), (1, None), (2, ""), (3, "unknown words"), (4, "漢字 naïve w55"), (4, "w1"), (None, "Q x9 İ"), (5, " ".join(f"w{k}" for k in range(60)))]
    items += [(10 + k, texts[r.randrange(700)]) for k in range(70)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS).withColumn("tid", F.lit("x")).withColumn("item", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("doc_id", F.lit("clash")).repartition(2)
    got = lexical.search(docs, asked)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(list(zip(ids, texts)), items)


def test_lexical_search_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, some).collect() == []
    assert lexical.search(some.withColumnRenamed("item_id", "doc_id"), some.where("false")).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), some).collect() == []


def test_tiers_keep_every_posting_and_bound_the_rest():
    import pyarrow as pa

    n = 300
    tf = np.random.default_rng(1).integers(1, 9, n).astype("<i4")
    batch = pa.record_batch({"segment": [1], "tid": [5], "docs": [np.arange(n, dtype="<i4").tobytes()], "tfs": [tf.tobytes()], "ns": [np.full(n, 20, "<i4").tobytes()]})
    (out,) = lexical._tiers(100, 2000)(iter([batch]))
    rows = out.to_pylist()
    impacts = [np.frombuffer(x["f"], "<i4") for x in rows]
    assert [len(f) for f in impacts] == [8, 56, n - 64]
    assert sorted(np.concatenate([np.frombuffer(x["docs"], "<i4") for x in rows]).tolist()) == list(range(n))
    assert (np.diff(np.concatenate(impacts)) <= 0).all()
    assert [x["residual"] for x in rows] == [int(impacts[1][0]), int(impacts[2][0]), 0]


# ---------------------------------------------------------------- language model
def some_model(seed=5, classes=7):
    r = np.random.default_rng(seed)
    return markov.Model(r.random(markov.STATES), r.random((markov.STATES, markov.STATES)) * 30, r.random((classes, markov.STATES)) * 300)


def plain_forward(m, seq):
    a, log = m.start * m.emit[seq[0]], 0.0
    for c in seq[1:]:
        s = a.sum()
        log += math.log10(s)
        a = (a / s) @ m.move * m.emit[c]
    return log + math.log10(a.sum())


def test_likelihood_is_that_of_the_forward_recursion():
    m, r = some_model(), np.random.default_rng(2)
    sizes = np.array([1, 2, 127, 128, 129, 256, 257, 5000, 1, 640])
    run = r.integers(0, 7, sizes.sum()).astype("<u2")
    cuts = np.split(run, np.cumsum(sizes)[:-1])
    assert np.allclose(markov.likelihoods(m, run, sizes), [plain_forward(m, c) for c in cuts], rtol=1e-12)


def test_likelihoods_of_all_texts_sum_to_one():
    m = some_model(classes=3)  # class 0 ends a text: all texts of up to n tokens, and what goes on behind them
    total = sum(10 ** plain_forward(m, [*s, 0]) for n in range(5) for s in itertools.product((1, 2), repeat=n))
    total += sum(10 ** plain_forward(m, s) for s in itertools.product((1, 2), repeat=5))
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_expected_counts_are_those_of_all_paths():
    m, states = some_model(), markov.STATES
    seqs = [[1], [2, 3], [4, 0, 6], [5, 5, 1, 0]]
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((7, states))
    for seq in seqs:
        paths = list(itertools.product(range(states), repeat=len(seq)))
        w = np.array([m.start[p[0]] * m.emit[seq[0], p[0]] * np.prod([m.move[a, b] * m.emit[c, b] for a, b, c in zip(p, p[1:], seq[1:])]) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            start[p[0]] += x
            for a, b in zip(p, p[1:]):
                move[a, b] += x
            for s, c in zip(p, seq):
                emit[c, s] += x
    got = markov.expected(m, np.concatenate(seqs).astype("<u2"), np.array([len(s) for s in seqs]))
    for a, b in zip(got, (start, move, emit)):
        assert np.allclose(a, b, rtol=1e-9)


def test_training_raises_the_likelihood():
    r = np.random.default_rng(8)
    seqs = [[*(r.integers(1, 4, n) + 3 * (n % 2)), 0] for n in r.integers(3, 400, 60)]
    run, sizes = np.concatenate(seqs).astype("<u2"), np.array([len(s) for s in seqs])
    m, before = some_model(), -np.inf
    for _ in range(4):
        now = markov.likelihoods(m, run, sizes).sum()
        assert now > before
        m, before = markov.Model(*markov.expected(m, run, sizes)), now


def test_scores(spark, monkeypatch):
    texts, r = corpus(4, 240)
    texts += [None, "", " \t ", "Word " * 900, "ünseen Ünseen", texts[5], texts[5]]
    ids = [*range(1, len(texts) - 2), None, 3, 3]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    got = {}

    class Words(markov.Words):
        def __init__(self, *a):
            super().__init__(*a)
            got["words"], got["self"] = {x["word"]: (x["c"], x["cls"]) for x in self.counts.collect()}, self

    train = markov._train
    monkeypatch.setattr(markov, "Words", Words)
    monkeypatch.setattr(markov, "_train", lambda *a: got.__setitem__("model", train(*a)) or got["model"])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS).withColumn("word", F.lit(1)).withColumn("segment", F.lit("x")).repartition(3)
    rows = markov.score_documents(docs).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for t in texts]
    count = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    unseen = sorted({w for ws in tokens for w in ws if w is not None and w not in count})
    w = got["self"]
    forms = {x["w"]: x["c"] for x in spark.createDataFrame([(u,) for u in unseen], "w string").select("w", markov.form(F.col("w"), w.first).alias("c")).collect()}
    want = []
    for i, ws, h in zip(ids, tokens, held):
        cls, inner = [], 0.0
        for x in ws:
            c, k = (count[None], 0) if x is None else got["words"].get(x, (0, forms.get(x)))
            assert x is None or c == count[x]
            cls.append(k)
            if k >= w.first:
                inner += math.log10((c + 1) / (w.n[k] + w.v[k] + 1))
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ws)
        want.append((i, h, len(ws), sum(count[x] > 0 for x in ws), n, base, plain_forward(got["model"], cls) + inner))
    assert len(rows) == len(want)
    key = lambda x: (repr(x[0]), x[2], round(x[5], 6))
    for a, b in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_scores_beat_the_base_on_held_out_documents(spark):
    out = markov.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").toPandas()
    n = out["n_tokens"].sum()
    assert out["score"].sum() / n > out["base_score"].sum() / n + 0.2
    assert (out["score"] > out["base_score"]).mean() > 0.9


def test_scores_of_few_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert markov.score_documents(none).collect() == []
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = markov.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0) and math.isfinite(r["score"])
    (r,) = markov.score_documents(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (None, False, 1, 1, 1)
    assert math.isclose(r["base_score"], math.log10(2 / 3))


# ---------------------------------------------------------------- hard negatives
def mined(rows, every):
    ok = [(k, i, y, [math.floor(256 * float(x)) for x in e]) for k, (i, e, y) in enumerate(rows) if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    ok = [x for x in ok if sum(c * c for c in x[3]) < 1 << 62]
    out = []
    for k, i, y, q in ok:
        if i is None or i % every:
            continue
        s = [(-sum(a * b for a, b in zip(q, e)), j is None, j or 0, y == z) for m, j, z, e in ok if m != k and len(e) == len(q)]
        for ps, pn, p, _ in sorted(x for x in s if x[3])[:5]:
            fit = sorted(x for x in s if not x[3] and 80 * -ps <= 100 * -x[0] <= 100 * -ps)[:5]
            out += [(i, None if pn else p, r + 1, None if nn else j, -ps, -ns) for r, (ns, nn, j, _) in enumerate(fit)]
    return sorted(out, key=repr)


def test_hard_negatives(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + 0.4 * r.normal(size=8)).astype("f4").tolist(), int(r.integers(0, 3))) for k in range(2600)]
    rows += [(5000 + k, rows[40][1], k % 4) for k in range(1300)]  # copies: ties by id, one key for a third of the rows
    rows += [(k, rows[9][1], rows[9][2]) for k in (None, None, 9, 9, 400)]  # null and repeated ids
    rows += [(7000, None, 1), (7100, [1.0, None] * 4, 1), (7200, [float("nan")] * 8, 1), (7300, [float("inf")] * 8, 1), (7400, [1.0] * 8, None)]
    rows += [(7500, [1.0, 2.0], 1), (7501, [1.0, 1.5], 1), (7502, [1.0, 1.4], 2), (7600, [], 1), (7601, [], 1), (7602, [], 2), (7700, [0.0] * 8, 1), (7800, [1e30] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("x")).withColumn("cell", F.lit(0)).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == mined(rows, 100)


def test_hard_negatives_large_numbers(spark):
    r = np.random.default_rng(12)
    rows = [(k, (r.integers(-(1 << 20), 1 << 20, 4) * 16.0).tolist(), k % 2) for k in range(120)]  # inner products beyond 2^53
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()), key=repr) == mined(rows, 10)


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(one, F.col("vec_id") % 100 == 0).collect() == []


def test_interval_scans_skip_cells():
    r = np.random.default_rng(13)
    centres = r.normal(size=(16, 6)) * 1000
    x = np.rint(np.concatenate([c + 20 * r.normal(size=(128, 6)) for c in centres]))
    most = float((x * x).sum(axis=1).max())
    s = negatives.Space(6, x, np.zeros(len(x), int), most, 200_000)
    cell, _ = s.cell(x)
    q = x[5]
    d = s.distances(np.append(q, 0.0)[None])[0]
    scores = x @ q
    least = int(np.sort(scores)[-20])
    seen = s.cells(d, 0.0, s.reach(float(q @ q), least))
    assert set(cell[scores >= least].tolist()) <= seen  # nothing that good is missed
    assert len(seen) < 0.8 * s.first[-1]


# ---------------------------------------------------------------- embeddings: plans of large tables
@pytest.mark.parametrize("plan", [4, 5])
def test_recall_of_large_plans(plan):
    """Pairs at the threshold meet with a probability of 0.95 at least in the plans of the largest tables too."""
    from weftline.llm import lattice

    r = np.random.default_rng(23 + plan)
    n, dim = 300, 64
    a, b = r.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    x = np.concatenate([a, 0.9005 * a + np.sqrt(1 - 0.9005**2) * b])
    home, near = lattice.cells(x, *lattice.PLANS[plan])
    h1, h2, n1, n2 = home[:n], home[n:], near[:n], near[n:]
    met = (h1 == h2).any(axis=1) | (h1[:, :, None] == n2).any(axis=(1, 2)) | (h2[:, :, None] == n1).any(axis=(1, 2))
    assert met.mean() >= 0.95
