"""Searches above a threshold by pivots against all products, with several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import pivots, similarity

KIND = "vec_id long, embedding array<double>, label string"


@pytest.fixture(scope="module")
def rows():
    """Eight clusters, one with a third of all rows, copies, opposite vectors, a zero vector and rows without label."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 12))
    x = np.concatenate([c + rng.normal(size=(n, 12)) * 0.15 for c, n in zip(centres, [120, 35, 35, 35, 35, 35, 35, 30], strict=True)])
    x[50:60], x[200], x[201] = x[50], -x[0], 0
    return [(i, v.tolist(), None if i % 11 == 0 else "pqr"[i % 3]) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def df(spark, rows):
    odd = [(9001, None, "p"), (None, rows[0][1], "p"), (9002, [float("nan")] * 12, "q")]
    return spark.createDataFrame(rows + odd, KIND).repartition(5)


def cosines(rows):
    x = np.array([r[1] for r in rows])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return u @ u.T


@pytest.mark.parametrize("t", [0.97, -0.2])
def test_pairs_equal_all_products(df, rows, monkeypatch, t):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    c = cosines(rows)
    got = similarity.pairs_above(df, t).collect()
    assert sorted([r["a"], r["b"]] for r in got) == np.argwhere(np.triu(c >= t, 1)).tolist()
    assert all(abs(r["cosine"] - c[r["a"], r["b"]]) < 1e-9 for r in got)


def test_two_tables(df, rows, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    own, c = F.pmod("vec_id", F.lit(5)) == 0, cosines(rows)
    got = similarity.pairs_above(df.where(own), 0.95, other=df.where(~own)).collect()
    want = {(i, j) for i, j in np.argwhere(c >= 0.95).tolist() if i % 5 == 0 and j % 5}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_most_block_pairs_are_skipped(df):
    p = pivots.choose(df)
    a = pivots.blocks(pivots.placed(df, p, "vec_id", "embedding", 16), p, 16)
    n = a.select("b").distinct().count()
    count = lambda t: pivots.block_pairs(a, a, pivots.angle_of(t), len(p), True).count()
    assert n == -(-360 // 16) and count(0.97) < 0.4 * n * (n + 1) / 2 and count(-1.0) == n * (n + 1) / 2


@pytest.mark.parametrize(("t", "size"), [(0.97, 16), (0.5, 4096)])
def test_exists(df, rows, t, size):
    own, c = F.pmod("vec_id", F.lit(5)) == 0, cosines(rows)
    want = {}
    for i in range(0, len(rows), 5):
        hits = [rows[j][2] for j in range(len(rows)) if j % 5 and c[i, j] >= t]
        if hits:
            known = [h == rows[i][2] for h in hits if h and rows[i][2]]
            want[i] = any(known) if known else None
    got = pivots.exists_above(df.where(own & F.col("vec_id").isNotNull()), df.where(~own), t, "label", size=size).collect()
    assert len(got) == len(want) and {r["id"]: r["same_label"] for r in got} == want
    bare = pivots.exists_above(df.where(own), df.where(~own), t, size=size).collect()
    assert {r["id"] for r in bare} == set(want)


def test_rows_that_are_done_meet_no_more_blocks(spark, monkeypatch):
    """All rows match their nearest block, so a second round has nothing to compare."""
    x = [(i, [1.0, i * 1e-4], "p") for i in range(64)]
    a, b = spark.createDataFrame(x, KIND), spark.createDataFrame(x, KIND)
    seen, meet = [], pivots._meet
    monkeypatch.setattr(pivots, "_meet", lambda left, *rest: seen.append(left.count()) or meet(left, *rest))
    assert pivots.exists_above(a, b, 0.9, "label", size=8).count() == 64
    assert seen[0] > 0 and len(seen) == 2 and seen[1] == 0


def test_empty(spark, df):
    none = spark.createDataFrame([], KIND)
    assert pivots.exists_above(none, df, 0.5).count() == 0 and pivots.exists_above(df, none, 0.5).count() == 0
    assert similarity.pairs_above(none, 0.5).count() == 0


def test_best_takes_ties_to_the_smaller_column():
    rng = np.random.default_rng(2)
    sim = np.round(rng.normal(size=(40, 300)), 1)
    sim[0, :], sim[1, 3:] = 0.5, -np.inf
    for k in (1, 7, 300, 400):
        assert (similarity._best(sim, k) == np.argsort(-sim, axis=1, kind="stable")[:, :k]).all()
