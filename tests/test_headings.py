from __future__ import annotations

import random

import numpy as np
import pandas as pd

from weftline.operators import headings, merge_fold
from weftline.plans.queries_text import fuzzy_dedup_headings

SCHEMA = "doc_id long, text string, source string"


def test_fingerprint_is_the_folds():
    for t in (None, "", "the", "Word word, other_word!", "Größe 12 été", "a b c d e f g " * 9):
        assert headings.fingerprint(t) & (1 << 64) - 1 == merge_fold.simhash(t or "")


def test_every_first_line_takes_part(spark, tmp_path):
    """More than sixteen lines a source, near copies late in it: as fuzzy_dedup over all its distinct lines in order."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(400)}"
    base = [[word() for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(500):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = word()
        t = r.choice([" ".join(w), " ".join(w), " ".join(word() for _ in range(r.randrange(1, 20))), " ".join(w) + " and", "", None])
        rows.append((r.choice([k, k, k, None, 7]), t and t + "\nrest", r.choice(["a", "a", "a", "b", None])))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, (tuple(x) for x in fuzzy_dedup_headings(spark, str(tmp_path)).collect())))
    want = []
    for source in ("a", "b", None):
        first: dict = {}
        for i, t, s in rows:
            if s == source:
                t = t and t.split("\n")[0]
                o = -(1 << 63) if i is None else i
                first[t] = min(o, first.get(t, o))
        order = sorted(first, key=lambda t: (first[t], t is not None, t or ""))
        assert len(order) > 16
        want += [(source, x["text"]) for x in merge_fold.fuzzy_dedup([{"text": t} for t in order])[0]]
    assert got == sorted(map(repr, want))


def test_fold_by_numbers():
    """What is kept by fingerprints and lengths alone is what fuzzy_dedup keeps of the texts, with more kept lines than one block."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(700)]
    fps = [r.choice(base) ^ sum(1 << r.randrange(64) for _ in range(r.randrange(7))) & (1 << 64) - 1 for _ in range(4000)]
    texts = [f"{k:05}" + "x" * r.randrange(30) for k in range(len(fps))]
    rows = pd.DataFrame({"g": "=a", "component": 1, "fp": np.array(fps, np.uint64).view(np.int64), "size": [len(t) for t in texts], "line": range(len(fps))})
    other = rows[:50].assign(g="=b", line=range(5000, 5050))
    out = pd.concat(list(headings._fold(iter([rows[:1500], rows[1500:1500], pd.concat([rows[1500:], other[:20]]), other[20:]]))))["line"].tolist()
    got = [k for k in out if k < 5000]
    assert [texts[k - 5000] for k in out if k >= 5000] == [x["text"] for x in merge_fold.fuzzy_dedup([{"text": t} for t in texts[:50]], prints=fps[:50])[0]]
    want = [x["text"] for x in merge_fold.fuzzy_dedup([{"text": t} for t in texts], prints=fps)[0]]
    assert len(want) > 256 and [texts[k] for k in got] == want


def test_no_task_holds_the_texts_of_a_component(spark):
    """Lists of lines are not collected: a component of long lines is folded by numbers."""
    lines = spark.createDataFrame([("a", k, f"one two three four five six seven eight nine ten {k % 3}" + " ten" * k) for k in range(50)], "source string, doc_id long, t string")
    out = headings.fold(lines)
    assert "collect_list" not in out._jdf.queryExecution().analyzed().toString()
    want = merge_fold.fuzzy_dedup([{"text": r["t"]} for r in lines.collect()])[0]
    assert sorted(r["heading"] for r in out.collect()) == sorted(x["text"] for x in want)
