"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become whole numbers, floor(scale * x). Each is cut into segments, coarse to fine; a segment is summed up by its mean
and the length of its deviations from it. For two vectors the distance within a segment of length L is at
least L * (difference of means)^2 + (difference of deviations)^2; with the norms known this is an upper bound on the inner product:
the sum over segments of L * mean * mean + deviation * deviation. A candidate whose bound is below the k-th best score
so far is out at the coarse level, else at the next one, and the survivors' scores are computed exactly.

Queries and candidates meet in blocks: each pair of a block of queries and a block of candidates is a task that
keeps k rows a query, and a window over those keeps the k best. Ties go to the smaller id.

Scores are exact: beyond 2**53 the products are taken in 64-bit integers, and a component or score that a long can't hold ends the query with an error.

Vectors that are null or empty or hold null or non-finite components take no part. Vectors of different length
never meet. A query's own row is no candidate for it; rows that repeat its id are. Null ids are candidates, the last among equal scores, never
queries. Only the id and the vector are read, so other columns may have any name. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import session, written

#: Segments at each level; rows in a block of queries and of candidates; queries bounded at once.
LEVELS, QUERY_BLOCK, BLOCK, AT_ONCE = (8, 16), 2048, 32768, 128


def segments(x: np.ndarray, n: int) -> np.ndarray:
    """For each row its segments' sqrt(L) * means, then lengths of their deviations: products of these rows bound the products of the rows of x from above."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int))
    size = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return np.hstack([total / np.sqrt(size), np.sqrt(np.maximum(square - total * total / size, 0))])


def search(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, k: int):
    """For each query its k best candidates here: (number of the query, number of the candidate, score) arrays. c must be in the order in which ties are resolved."""
    fc, fq = c.astype(np.float64), q.astype(np.float64)
    wide = float(np.abs(fc).max(initial=0)) * float(np.abs(fq).max(initial=0)) * fc.shape[1] >= 2**53
    exact = c if wide else fc
    longest = float(np.sqrt((fc * fc).sum(1).max(initial=0)))
    levels = [(segments(fq, n), segments(fc, n)) for n in LEVELS]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    most = min(k + 1, len(c))  # a query's own row may be among them
    for i in range(0, len(q), AT_ONCE):
        bound = levels[0][0][i : i + AT_ONCE] @ levels[0][1].T
        first = np.argpartition(-bound, most - 1, axis=1)[:, :most]
        for j in range(len(bound)):
            x, own = (q if wide else fq)[i + j], q_row[i + j]
            seed = first[j][c_row[first[j]] != own]
            scores = exact[seed] @ x
            least = float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf
            slack = 1e-6 * (1 + abs(least)) + 1e-12 * longest * float(np.sqrt((fq[i + j] ** 2).sum())) if np.isfinite(least) else 0
            left = np.flatnonzero(bound[j] >= least - slack)
            for fine_q, fine_c in levels[1:]:
                left = left[fine_c[left] @ fine_q[i + j] >= least - slack]
            left = left[c_row[left] != own]
            scores = exact[left] @ x
            if wide and len(left) and np.abs(fc[left] @ fq[i + j]).max() >= 2**62:
                raise OverflowError("a score is too large for a long")
            best = np.lexsort((np.arange(len(scores)), ~scores if wide else -scores))[:k]
            out.append((np.full(len(best), i + j), left[best], scores[best].astype(np.int64) if wide else np.rint(scores[best]).astype(np.int64)))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of highest score for each row of `vectors` with is_query: query_id, rank (from 1), vec_id, score."""
    spark = session(vectors.sparkSession)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()).alias("q"), F.monotonically_increasing_id().alias("row"))
    base = base.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    base = base.withColumn("v", F.expr(f"transform(v, x -> if(abs({scale}D * x) < 9.2e18D, floor({scale}D * x), cast(raise_error('a component is too large for a long') as bigint)))")).withColumn("d", F.size("v"))
    base = written(base, "vectors")
    n = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)).alias("q")).first()
    q_blocks, c_blocks = max(1, -(-n["q"] // QUERY_BLOCK)), max(1, -(-n["n"] // BLOCK))

    def packed(batches):
        """Rows of a batch that go to the same block as one row."""
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            ids, rows = get("id").cast(pa.int64()), np.asarray(get("row"))
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(np.iinfo(np.int64).max))
            vs, d, q, block = get("v"), np.asarray(get("d")), np.asarray(get("q").cast(pa.int8())), np.asarray(get("b"))
            flat, offs = np.asarray(vs.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(d)])
            out = []
            for key in {*zip(d.tolist(), q.tolist(), block.tolist(), strict=True)}:
                at = np.flatnonzero((d == key[0]) & (q == key[1]) & (block == key[2]))
                m = flat[(offs[at][:, None] + np.arange(key[0]))]
                small = np.abs(m).max(initial=0) < 32768
                out.append((*key, ids[at].tobytes(), known[at].tobytes(), rows[at].tobytes(), m.astype(np.int16 if small else np.int64).tobytes(), bool(small)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()], strict=True)], ["d", "q", "b", "ids", "known", "rows", "m", "small"])

    kind = "d int, q byte, b int, ids binary, known binary, rows binary, m binary, small boolean"
    place = F.xxhash64("row")
    asked = base.where("q").withColumn("b", F.pmod(place, F.lit(q_blocks)).cast("int")).withColumn("q", F.lit(True)).mapInArrow(packed, kind)
    given = base.withColumn("b", F.pmod(place, F.lit(c_blocks)).cast("int")).withColumn("q", F.lit(False)).mapInArrow(packed, kind)
    pairs = asked.select("*", F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb")).unionByName(given.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.col("b").alias("cb")))

    def met(table: pa.Table) -> pa.Table:
        sides: dict[int, list] = {0: [], 1: []}
        for d, q, ids, known, rows, m, small in zip(*[table.column(c).to_pylist() for c in ("d", "q", "ids", "known", "rows", "m", "small")], strict=True):
            sides[q].append((np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(rows, np.int64), np.frombuffer(m, np.int16 if small else np.int64).reshape(-1, d).astype(np.int64)))
        names = ["query_row", "query_id", "vec_id", "score"]
        if not sides[0] or not sides[1]:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        (c_id, c_known, c_row, c), (q_id, _, q_row, q) = ([np.concatenate(x) for x in zip(*sides[s], strict=True)] for s in (0, 1))
        order = np.lexsort((c_row, c_id))
        c_id, c_known, c_row, c = c_id[order], c_known[order], c_row[order], c[order]
        i, j, score = search(q, q_row, c, c_row, c_id, k)
        return pa.table({"query_row": q_row[i], "query_id": q_id[i], "vec_id": pa.array(c_id[j], mask=~c_known[j]), "score": score})

    found = pairs.groupBy("d", "qb", "cb").applyInArrow(met, "query_row long, query_id long, vec_id long, score long")
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
