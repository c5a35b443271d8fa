import random
import re

import numpy as np
import pytest

from granary.llm import ngram_join as N

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Set sizes and components of (id, text) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=0, groups=12):
    """Groups of edited copies, a passage common to many, short and repeated-word texts."""
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    common = [word() for _ in range(40)]
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 6, 12, 60, 200]))]
        if r.random() < 0.5:
            base += common
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(int(len(copy) * r.random() * 0.06)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(common + [word() for _ in range(3)])) for i in range(10)]
    rows += [(len(rows), "To to to to of of of of in In in"), (len(rows) + 1, "A b"), (len(rows) + 2, "a B"), (len(rows) + 3, None), (len(rows) + 4, ""), (len(rows) + 5, "  ")]
    return rows


@pytest.mark.parametrize(("hot", "block", "seed"), [(128, 16_000, 0), (3, 4, 1), (2, 16_000, 2)])
def test_components_equal_brute_force(spark, monkeypatch, hot, block, seed):
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(rng.integers(1, 8)):
            copy = base.copy()
            at = rng.random(len(copy)) < rng.random() * 0.2
            copy[at] = rng.integers(0, 2**63, at.sum()).astype(np.uint64)
            sets.append(np.unique(copy))
    sets.sort(key=len)
    union = N.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if N.overlap(sets[i], sets[j]) >= N.need(len(sets[i]), len(sets[j])):
                union.join(i, j)
    assert N.linked(sets)[0] == [union.find(i) for i in range(len(sets))]


def test_edge_rows(edges, nothing):
    rows = N.join(edges.withColumnRenamed("n_chars", "n_shingles")).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows)
    assert got == [(0, 2, 7), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (7, 2, 7), (8, 1, 8)]
    assert N.join(nothing).count() == 0


def test_one_of_each(edges):
    left = N.one_of_each(edges)
    assert left.columns == edges.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"]) == [1, 2, 3, 4, 7, 8]
