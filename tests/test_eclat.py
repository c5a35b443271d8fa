"""Itemsets from bitmaps, against counting every subset."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from granary.operators import mining

BASKETS = [("a", "b", "c", "d"), ("a", "b", "c"), ("a", "b", "c", "d"), ("b", "d"), ("é", "a"), ("a", "b", "c", "d", "é"), ("z",)]


def plain(baskets, least):
    n = Counter(s for x in baskets for k in range(1, len(x) + 1) for s in combinations(sorted(x), k))
    return {s: c for s, c in n.items() if c >= least}


def shown(df):
    rows = df.collect()
    assert all(r["size"] == len(r["items"]) for r in rows)
    return {tuple(r["items"]): r["n"] for r in rows}


@pytest.mark.parametrize("block", [1024, 2])
def test_any_length(spark, block):
    items = spark.createDataFrame([(t, i) for t, x in enumerate(BASKETS) for i in x], "tid long, item string")
    assert shown(mining.eclat(items, 2, block=block)) == plain(BASKETS, 2)


def test_over_several_chunks_and_none(spark):
    # 70,000 transactions, three bitmaps; item 0 is in all of them
    items = spark.range(70_000).select(F.col("id").alias("tid"), F.explode(F.expr("filter(array(0L, 2L, 3L, 5L), k -> k = 0 or id % k = 0)")).alias("item"))
    got = shown(mining.eclat(items, 2000))
    share = lambda ks: len(range(0, 70_000, max(1, __import__("math").prod(k for k in ks if k))))
    want = {s: share(s) for k in range(1, 5) for s in combinations((0, 2, 3, 5), k)}
    assert got == {s: n for s, n in want.items() if n >= 2000}
    assert shown(mining.eclat(items.limit(0), 1)) == {}
    with pytest.raises(ValueError):
        mining.eclat(items, 0)
