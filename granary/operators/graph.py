"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.store import drop_written, written

#: A node with more than a HUBS-th of all ends of edges is a hub: the minima of these nodes, HUBS at most, are broadcast, and their edges don't meet in one task.
HUBS = 1000


def _with_least(rows: DataFrame, least: DataFrame, hubs: list[int]) -> DataFrame:
    """rows(u, v) with the m of their u in least(u, m)."""
    if not hubs:
        return rows.join(least, "u")
    hub = F.col("u").isin(hubs)
    known = F.broadcast(least.where(hub))
    return rows.where(hub).join(known, "u").unionByName(rows.where(~hub).join(least.where(~hub), "u"))


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges(a, b), any order, repeats and loops allowed: (node, root) with the smallest node of each component as root.

    Rounds of large-star and small-star steps: each node's neighbours move to the smallest of them. Groups are aggregated
    before the shuffle, no step gathers a node's neighbours, hubs' edges don't move, and each round is a table in the shared folder."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def mark(x):
        """The number of edges, a sum of hashes, and the hubs."""
        n = x.count()
        degrees = _both(x).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        r = degrees.agg(F.sum("h").alias("h"), F.collect_list(F.when(F.col("n") > max(100, 2 * n // HUBS), F.col("u"))).alias("hubs")).first()
        return n, r["h"], r["hubs"]

    old = mark(e)
    for _ in range(most_rounds):
        if not old[0]:
            break
        # Large star: a node's larger neighbours are linked to its smallest neighbour or itself.
        both = _both(e)
        large = _with_least(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), old[2])
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node's smaller neighbours and itself are linked to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low, old[2]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "edges")
        now = mark(new)
        drop_written(e)
        e, same, old = new, now[:2] == old[:2], now
        if same:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
