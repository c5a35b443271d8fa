"""Exact and hashed similarity of dense vectors.

Vectors meet in pairs of blocks: a block's vectors travel packed in one row for each batch, and each pair of blocks is one matrix
product in one task. No side is broadcast, and memory is that of two blocks. Searches above a threshold pass over pairs of blocks by
pivots."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators import pivots

BLOCK = 4096
PACKED = "b int, ids binary, vecs binary, width int"


def _pack(batches):
    for batch in batches:
        ids, vecs, block = np.asarray(batch.column(0)), batch.column(1), np.asarray(batch.column(2))
        if not len(ids):
            continue
        m = np.asarray(vecs.flatten(), dtype=np.float64).reshape(len(ids), -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        out = [(int(b), ids[block == b].tobytes(), m[block == b].tobytes(), m.shape[1]) for b in np.unique(block)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.int32()], strict=True)], ["b", "ids", "vecs", "width"])


def packed(df: DataFrame, n_blocks: int, id_col: str, vec_col: str) -> DataFrame:
    """Unit vectors by block. All vectors of df must have one width; null ones are left out."""
    x = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    return x.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"), F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).cast("int")).mapInArrow(_pack, PACKED)


def _met(df_a: DataFrame, df_b: DataFrame, id_col: str, vec_col: str, run, schema: str, same: bool, cosine: float | None = None) -> DataFrame:
    """run over the pairs of blocks: over all, or over those that can hold a pair at or above the cosine."""
    na, nb = (max(1, -(-x.count() // BLOCK)) for x in (df_a, df_b))
    if cosine is not None and na + nb > 2:
        return pivots.met(df_a, df_b, id_col, vec_col, run, schema, same, cosine, BLOCK)
    each = lambda x, side, own, other, n: x.select("*", F.lit(side).alias("side"), F.col("b").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other))
    both = each(packed(df_a, na, id_col, vec_col), 0, "x", "y", nb).unionByName(each(packed(df_b, nb, id_col, vec_col), 1, "y", "x", na))
    if same:
        both = both.where("x <= y")

    def met(table: pa.Table) -> pa.Table:
        sides: list[list] = [[], []]
        for s, ids, vecs, width in zip(*[table.column(c).to_pylist() for c in ("side", "ids", "vecs", "width")], strict=True):
            sides[s].append((np.frombuffer(ids, np.int64), np.frombuffer(vecs).reshape(-1, width)))
        if not sides[0] or not sides[1]:
            return run(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)))
        (ia, a), (ib, b) = (tuple(np.concatenate(x) for x in zip(*s, strict=True)) for s in sides)
        return run(ia, a, ib, b)

    return both.groupBy("x", "y").applyInArrow(met, schema)


def pairs_above(df: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", other: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) of pairs at or above the threshold: within df (a < b), or of rows a of df with rows b of another. Products are made where pivots don't rule them out."""
    same = other is None

    def run(ia, a, ib, b):
        out = []
        for i in range(0, len(ia), 512):
            sim = a[i : i + 512] @ b.T
            x, y = np.nonzero(sim >= threshold)
            out.append((ia[i + x], ib[y], sim[x, y]))
        p, q, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": p, "b": q, "cosine": s})

    x = _met(df, df if same else other, id_col, vec_col, run, "a long, b long, cosine double", same, threshold)
    if not same:
        return x
    # Blocks meet once, so a pair comes once, in either order (twice within a block).
    return x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("cosine", 12).alias("cosine")).distinct()


def _by_id(ids, vecs):
    order = np.argsort(ids, kind="stable")
    return ids[order], vecs[order]


def near_counts(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(id, n): how many rows, itself among them, each row has at or above the threshold. A pair of blocks gives one count a row, not its pairs. Ids are distinct."""

    def run(ia, a, ib, b):
        (ia, a), (ib, b) = _by_id(ia, a), _by_id(ib, b)
        inner = np.array_equal(ia, ib)
        own, other = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        for i in range(0, len(ia), 512):
            hit = a[i : i + 512] @ b.T >= threshold
            if inner:  # a row counts itself, whatever the product's last bit says
                hit[np.arange(len(hit)), i + np.arange(len(hit))] = True
            own[i : i + 512] = hit.sum(1)
            other += hit.sum(0)
        ids, n = (ia, own) if inner else (np.concatenate([ia, ib]), np.concatenate([own, other]))
        return pa.table({"id": ids[n > 0], "n": n[n > 0]})

    return _met(df, df, id_col, vec_col, run, "id long, n long", True).groupBy("id").agg(F.sum("n").alias("n"))


def _forest(hit, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever the two sides' matrix of hits joins: (row of a, row of b) from a search by breadth, a row or column opened once."""
    left_a, left_b, out = np.ones(na, bool), np.ones(nb, bool), [np.zeros((2, 0), np.int64)]
    for start in range(na):
        if not left_a[start]:
            continue
        left_a[start] = False
        rows = np.array([start])
        while len(rows):
            cols = np.flatnonzero(hit[rows].any(0) & left_b)
            left_b[cols] = False
            out.append(np.stack([rows[hit[np.ix_(rows, cols)].argmax(0)], cols]))
            back = hit[:, cols]
            new = np.flatnonzero(back.any(1) & left_a)
            left_a[new] = False
            out.append(np.stack([new, cols[back[new].argmax(1)] if len(cols) else new]))
            rows = new
    return tuple(np.concatenate(out, 1))


def near_forest(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(a, b): links at or above the threshold that join the same rows as all such links do; from each pair of blocks fewer than it has rows."""

    def run(ia, a, ib, b):
        hit = np.concatenate([a[i : i + 512] @ b.T >= threshold for i in range(0, len(ia), 512)]) if len(ia) and len(ib) else np.zeros((len(ia), len(ib)), bool)
        x, y = _forest(hit, len(ia), len(ib))
        keep = ia[x] != ib[y]
        return pa.table({"a": ia[x][keep], "b": ib[y][keep]})

    return _met(df, df, id_col, vec_col, run, "a long, b long", True)


def first_near(df: DataFrame, other: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(id, first): for rows of df the smallest id of the other's rows at or above the threshold, if there is one."""

    def run(ia, a, ib, b):
        (ib, b), out = _by_id(ib, b), [(ia[:0], ib[:0])]
        for i in range(0, len(ia), 512):
            hit = a[i : i + 512] @ b.T >= threshold
            at = np.flatnonzero(hit.any(1))
            out.append((ia[i + at], ib[hit[at].argmax(1)] if len(at) else ib[:0]))
        p, q = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"id": p, "first": q})

    return _met(df, other, id_col, vec_col, run, "id long, first long", False).groupBy("id").agg(F.min("first").alias("first"))


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest values, ties to the smaller column: a selection finds the k-th value, and only what reaches it is sorted."""
    if sim.shape[1] <= k:
        return np.argsort(-sim, axis=1, kind="stable")
    kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    out = np.empty((len(sim), k), np.int64)
    for i, row in enumerate(sim):
        at = np.flatnonzero(row >= kth[i])
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def knn(df: DataFrame, k: int, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", include_self: bool = False) -> DataFrame:
    """(query, rank, neighbour, cosine): the k nearest rows of df for each query (of df where none are given), ties to the smaller id. A task keeps k a query; a window keeps the best."""
    q = df if queries is None else queries

    def run(ia, a, ib, b):
        order = np.argsort(ib, kind="stable")
        ib, b, out = ib[order], b[order], []
        for i in range(0, len(ia), 512):
            sim = np.round(a[i : i + 512] @ b.T, 12)
            if not include_self:
                sim[ia[i : i + 512, None] == ib[None]] = -np.inf
            top = _best(sim, k)
            s = np.take_along_axis(sim, top, 1)
            keep = np.isfinite(s)
            out.append((np.repeat(ia[i : i + 512], keep.sum(1)), ib[top[keep]], s[keep]))
        p, n, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": p, "neighbour": n, "cosine": s})

    found = _met(q, df, id_col, vec_col, run, "query long, neighbour long, cosine double", False)
    w = W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "cosine")


def purity(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(id, label): mean share of neighbours with the query's label, accuracy of their majority vote (ties to the smallest label), and chance."""
    own = labels.select(F.col("id").alias("query"), F.col("label").alias("own"))
    x = neighbours.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").join(own, "query")
    votes = x.groupBy("query", "own", "label").agg(F.count("*").alias("n"))
    per = votes.groupBy("query", "own").agg((F.sum(F.when(F.col("label") == F.col("own"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("vote"))
    chance = labels.groupBy("label").agg(F.count("*").alias("c")).select((F.col("c") / F.sum("c").over(W.partitionBy())).alias("p")).agg(F.sum(F.col("p") * F.col("p")).alias("chance"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("purity"), F.round(F.avg((F.col("vote") == F.col("own")).cast("int")), 6).alias("vote_accuracy")).crossJoin(chance.select(F.round("chance", 6).alias("chance")))


def class_cosine(df: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean cosine within and between classes, without a pair join: a class's sum vector S has |S|^2 = n + the sum over its ordered pairs; two classes' sums have the product of all cross pairs."""
    v = F.col(vec_col).cast("array<double>")
    x = df.where(F.col(vec_col).isNotNull()).select(F.col(label).alias("label"), F.posexplode(v).alias("d", "x"), F.expr(f"sqrt(aggregate(cast({vec_col} as array<double>), 0D, (s, x) -> s + x * x))").alias("norm"))
    sums = x.groupBy("label", "d").agg(F.sum(F.col("x") / F.col("norm")).alias("s"))
    n = df.where(F.col(vec_col).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    a, b = sums.select(F.col("label").alias("a"), "d", F.col("s").alias("sa")), sums.select(F.col("label").alias("b"), "d", F.col("s").alias("sb"))
    dots = a.join(b, "d").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    y = dots.join(F.broadcast(n.select(F.col("label").alias("a"), F.col("n").alias("na"))), "a").join(F.broadcast(n.select(F.col("label").alias("b"), F.col("n").alias("nb"))), "b")
    mean = F.when((F.col("a") == F.col("b")) & (F.col("na") > 1), (F.col("dot") - F.col("na")) / (F.col("na") * (F.col("na") - 1))).when(F.col("a") != F.col("b"), F.col("dot") / (F.col("na") * F.col("nb")))
    return y.select("a", "b", F.round(mean, 6).alias("mean_cosine"))


# ---- hashing ----

def plane(table: int, bit: int, dim: int) -> float:
    """A component of a hyperplane, from md5 so that any engine makes the same."""
    return (int(hashlib.md5(f"{table}|{bit}|{dim}".encode()).hexdigest()[:8], 16) % 2001 - 1000) / 1000


def signatures(df: DataFrame, tables: int, bits: int, width: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, table, bucket): the signs of products with `bits` planes for each table."""
    v = F.col(vec_col).cast("array<double>")

    def side(t, b):
        p = F.array(*[F.lit(plane(t, b, i)) for i in range(width)])
        return F.when(F.aggregate(F.zip_with(v, p, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) >= 0, F.lit(1 << b)).otherwise(F.lit(0))

    rows = F.array(*[F.struct(F.lit(t).alias("t"), sum((side(t, b) for b in range(bits)), F.lit(0)).alias("bucket")) for t in range(tables)])
    return df.where(v.isNotNull()).select(F.col(id_col).alias("id"), F.explode(rows).alias("s")).select("id", F.col("s.t").alias("t"), F.col("s.bucket").alias("bucket"))


def candidates(signed: DataFrame, is_query: Column) -> DataFrame:
    """Distinct (query, candidate) that share a bucket in some table."""
    q = signed.where(is_query).select(F.col("id").alias("query"), "t", "bucket")
    return q.join(signed.select(F.col("id").alias("candidate"), "t", "bucket"), ["t", "bucket"]).where("query <> candidate").select("query", "candidate").distinct()


def rerank(cands: DataFrame, df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest candidates of each query by exact cosine."""
    v = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = cands.join(v.select(F.col("id").alias("query"), F.col("v").alias("a")), "query").join(v.select(F.col("id").alias("candidate"), F.col("v").alias("b")), "candidate")
    x = x.select("query", F.col("candidate").alias("neighbour"), F.round(dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))), 12).alias("cosine"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found, over all queries."""
    x = truth.select("query", "neighbour").join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return x.agg(F.count_distinct("query").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def collision(cosine: Column, bits: int, tables: int) -> Column:
    """Chance that two vectors share a bucket somewhere: 1 - (1 - p^bits)^tables with p = 1 - angle / pi."""
    p = 1 - F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) / F.lit(np.pi)
    return 1 - F.pow(1 - F.pow(p, bits), tables)
