"""Percentiles by selection, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators.quantiles import quantiles

Q = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
ROW = "g string, v double, u double, n long"


def same(a, b):
    return all((x == y) or (np.isnan(x) and np.isnan(y)) or abs(x - y) <= 1e-12 * max(abs(x), abs(y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("bins", "direct"), [(64, 0), (4096, 0), (4096, 100_000)])
def test_equals_sorting(spark, bins, direct):
    rng = np.random.default_rng(bins)
    wide = [float(10.0**x) for x in rng.uniform(-8, 8, 200)] + [-1e308, 1e308]
    groups = {"a": wide, "b": [3.0] * 50, "c": [1.0], None: [float(x) for x in rng.integers(-5, 5, 90)], "hot": [0.5] * 900 + [1.0, 2.0]}
    rows = [(g, v, float(i), 1) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", None, None, 1), ("empty", None, None, 1)]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    got = {r["g"]: r for r in quantiles(df, {"v": F.col("v"), "u": F.col("u")}, Q, ["g"], bins=bins, direct=direct).collect()}
    assert set(got) == {*groups, "empty"} and got["empty"]["v"] is None and got["empty"]["u"] is None
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        for name, x in (("v", s), ("u", [float(i) for i in range(n)])):
            want = [x[int(np.floor(q * (n - 1)))] * (1 - (q * (n - 1)) % 1) + x[int(np.ceil(q * (n - 1)))] * ((q * (n - 1)) % 1) for q in Q]
            assert same(got[g][name], want), (g, name)


@pytest.mark.parametrize("g", ["n", "v", "m", "lo"])
def test_names_of_groups_do_not_clash(spark, g):
    df = spark.createDataFrame([("x", 1.0), ("x", 4.0), ("y", 2.0)], f"{g} string, val double")
    assert {r[0]: r["med"] for r in quantiles(df, {"med": F.col("val")}, [0.5], [g], direct=0).collect()} == {"x": [2.5], "y": [2.0]}


@pytest.mark.parametrize("direct", [0, 100_000])
def test_ends_weights_and_empty_tables(spark, direct):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("x", v, 0.0, n) for v, n in ((-inf, 2), (1.0, 3), (2.0, 1), (inf, 1), (nan, 2))], ROW)
    got = quantiles(df, {"v": F.col("v")}, [i / 8 for i in range(9)], weight=F.col("n"), direct=direct).collect()
    assert len(got) == 1 and same(got[0]["v"], [-inf, -inf, 1.0, 1.0, 1.0, 2.0, inf, nan, nan])
    assert [tuple(r) for r in quantiles(df.limit(0), {"v": F.col("v"), "u": F.col("u")}, Q, direct=direct).collect()] == [(None, None)]
    assert quantiles(df.limit(0), {"v": F.col("v")}, Q, ["g"], direct=direct).collect() == []
