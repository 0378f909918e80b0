"""Near-duplicate removal with null and repeated ids."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from weftline.llm import simhash

from .test_llm import docs_of

WORDS = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]


def test_null_ids_stay(spark):
    """Unique documents without an id stay; of copies without an id one stays; an id comes before none."""
    texts = [WORDS[0], WORDS[1], WORDS[1].upper(), WORDS[2], WORDS[2].upper(), WORDS[3]]
    d = docs_of(spark, texts, ids=[None, None, None, None, 5, 6])
    kept = [(x["doc_id"], x["text"].lower()) for x in simhash.drop_near_duplicates(d).collect()]
    assert sorted(kept, key=str) == sorted([(None, WORDS[0]), (None, WORDS[1]), (5, WORDS[2]), (6, WORDS[3])], key=str)
    groups = simhash.simhash_groups(d).collect()
    assert len(groups) == 6 and sorted(map(str, (x["component_id"] for x in groups))) == ["5", "5", "6", "None", "None", "None"]


def test_repeated_ids(spark):
    """A near duplicate goes though its id belongs to a kept row too; different texts of one id both stay."""
    d = docs_of(spark, [WORDS[0], WORDS[1], WORDS[0].upper(), WORDS[1], WORDS[2]], ids=[1, 2, 2, 2, 1])
    kept = sorted((x["doc_id"], x["text"].lower()) for x in simhash.drop_near_duplicates(d).collect())
    assert kept == sorted([(1, WORDS[0]), (2, WORDS[1]), (1, WORDS[2])])


@pytest.mark.parametrize("third", [False, True])
def test_anchors_with_and_without_a_third_codeword(third):
    """Any two fingerprints within two bits meet at the home of each, and a home is among the replicas' anchors once."""
    r = np.random.default_rng(5)
    fps = r.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    home, rows, keys = simhash.anchors(fps, 2, third)
    own = [set(keys[rows == k].tolist()) for k in range(len(fps))]
    assert all(len(s) == (rows == k).sum() for k, s in enumerate(own))
    for bits in [(), *((b,) for b in range(64)), *itertools.islice(itertools.combinations(range(64), 2), 0, None, 7)]:
        near = fps ^ np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)
        assert all(h in s for h, s in zip(simhash.anchors(near, 2, third)[0].tolist(), own)), bits


@pytest.mark.parametrize("third", [False, True])
def test_links_of_hot_and_cold_anchors(spark, monkeypatch, third):
    """Components are those of all pairs, whether anchors are joined or cut into grids of several rows and columns."""
    monkeypatch.setattr(simhash, "HOT_HOMES", 3)
    monkeypatch.setattr(simhash, "CELL", 4)
    monkeypatch.setattr(simhash, "PROBES", 16)
    r = np.random.default_rng(6)
    seeds = r.integers(-(1 << 62), 1 << 62, 12, dtype=np.int64)
    fps = {0}
    for k in range(260):
        x = int(seeds[k % 12])
        for b in r.choice(64, r.integers(0, 6), replace=False).tolist():
            x ^= (1 << b) if b < 63 else -(1 << 63)
        fps.add(x)
    fps = sorted(fps)
    groups = spark.createDataFrame([(x, x) for x in fps], "fp long, rep long").repartition(3)
    links = simhash.fingerprint_links(groups, third).collect()
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    at = {x: k for k, x in enumerate(fps)}

    def classes(pairs):
        parent = list(range(len(fps)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[root(a)] = root(b)
        return [min(j for j in range(len(fps)) if root(j) == root(i)) for i in range(len(fps))]

    found = [(at[x["a"]], at[x["b"]]) for x in links]
    assert classes(found) == classes(np.argwhere(near).tolist())
