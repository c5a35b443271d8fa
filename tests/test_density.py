"""Density clusters against a plain search, with several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import cluster, similarity


def plain(x, eps, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 1 - eps
    np.fill_diagonal(near, True)
    core, out = near.sum(1) >= least, np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and out[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if out[j] < 0:
                    out[j] = i
                    todo += np.flatnonzero(near[j] & core).tolist()
    for i in np.flatnonzero(~core):
        mates = np.flatnonzero(near[i] & core)
        out[i] = out[mates[0]] if len(mates) else -1
    return out.tolist()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(40, 4)) * 0.35 for c in np.eye(4)[:3] * 2])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[3], (900, None)], "vec_id long, embedding array<double>").repartition(5)
    return x, df


@pytest.mark.parametrize(("block", "eps", "least"), [(4096, 0.03, 6), (17, 0.03, 6), (17, 0.01, 4)])
def test_equals_plain(points, monkeypatch, block, eps, least):
    monkeypatch.setattr(similarity, "BLOCK", block)
    x, df = points
    rows = cluster.dbscan(df, eps, least).collect()
    got = {r["id"]: r["cluster"] for r in rows}
    assert len(rows) == len(x) + 2 and got.pop(900) == -1
    assert [got[i] for i in range(len(x))] == plain(x, eps, least)


def test_forest_is_small_and_joins_all():
    hit = np.random.default_rng(1).random((50, 70)) < 0.05
    a, b = similarity._forest(hit, 50, 70)
    assert len(a) < 120 and hit[a, b].all()

    def groups(pairs):
        root = list(range(120))
        for i, j in pairs:
            p, q = root[i], root[j + 50]
            root = [p if r == q else r for r in root]
        return [root.index(r) for r in root]

    assert groups(zip(a, b, strict=True)) == groups(np.argwhere(hit))


def test_sweep_and_nothing(points, spark):
    x, df = points
    got = {r["eps"]: r for r in cluster.dbscan_sweep(df.where("vec_id < 900").dropDuplicates(["vec_id"]), [0.01, 0.03], 6).collect()}
    for eps, r in got.items():
        want = plain(x, eps, 6)
        sizes = [want.count(c) for c in set(want) - {-1}]
        assert (r["clusters"], r["noise"], r["largest"]) == (len(sizes), want.count(-1), max(sizes, default=0))
    assert cluster.dbscan(df.limit(0), 0.1, 3).collect() == []
    assert [r["cluster"] for r in cluster.dbscan(spark.range(3).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")), 0.1, 9).collect()] == [-1] * 3
