"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets its rank in the order of (doc_id, crc32, size); a keyed permutation of 0..N-1 maps the rank to a
place, and the place alone gives shard = place mod shards and slot = place div shards. So row counts differ by one
at most, slots have no gaps, and both ways are computable: `place` from a rank, `rank` from a shard and slot.

Null doc_ids and texts are rows like others (null text: no bytes, CRC 0); repeated rows get places of their own, and
as they are equal in every column it doesn't matter which gets which. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import hashable, session, written

ROUNDS, MASK = 4, 0xFFFFFFFF
MULTIPLIER, STEP = 2654435761, 40503


def sides(n: int) -> tuple[int, int]:
    """Two radixes whose product is at least n and hardly above it, so that walks are short."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(x, key: int):
    """A round function on 32 bits; its products stay below 2**63."""
    y = ((x & 0x7FFFFFFF) * MULTIPLIER + key * STEP + key) & MASK
    y = y ^ (y >> 15)
    y = ((y & 0x7FFFFFFF) * MULTIPLIER) & MASK
    return y ^ (y >> 13)


def _step(x, a: int, b: int, seed: int):
    left, right = x // b, x % b
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = (left + _round(right, seed + r)) % a
        else:
            right = (right + _round(left, seed + r)) % b
    return left * b + right


def _back(x, a: int, b: int, seed: int):
    left, right = x // b, x % b
    for r in reversed(range(ROUNDS)):
        if r % 2 == 0:
            left = (left - _round(right, seed + r)) % a
        else:
            right = (right - _round(left, seed + r)) % b
    return left * b + right


def place(rank: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The place of each rank below n (back: the rank of each place). Values that leave 0..n-1 walk on along their cycle."""
    a, b = sides(n)
    step = _back if back else _step
    x = step(np.asarray(rank, np.int64), a, b, seed)
    while (out := x >= n).any():
        x[out] = step(x[out], a, b, seed)
    return x


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df, written, with `_rank` from 0 in the given order: ranges are sorted apart and shifted by the counts before them."""
    sort = [F.col(c).asc_nulls_first() for c in order]
    cut = written(df.repartitionByRange(*sort).sortWithinPartitions(*sort).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranges")
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).orderBy("_range").collect()  # one row a partition
    shift, total = [], 0
    for r in counts:
        shift.append((r["_range"], total - r["_first"]))
        total += r["_n"]
    shifts = df.sparkSession.createDataFrame(shift or [(0, 0)], "_range int, _shift long")
    return cut.join(F.broadcast(shifts), "_range").withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift"), total


def shard(df: DataFrame, shards: int, seed: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df's key and size, text_crc32, shard, slot and the global rank and place they come from."""
    session(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(F.col(key).alias("_key"), (F.octet_length(body) + F.lit(16)).cast("long").alias("_size"), F.crc32(F.encode(body, "UTF-8")).alias("_crc"))
    rows, n = ranked(slim, ["_key", "_crc", "_size"])

    @F.pandas_udf("long")
    def placed(rank: pd.Series) -> pd.Series:
        return pd.Series(place(rank.to_numpy(), n, seed))

    at = rows.withColumn("_place", placed("_rank"))
    return at.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_place div {shards}").cast("long").alias("slot"),
        F.col("_rank").alias("row_number"), F.col("_place").alias("place"),
    )


def shard_rows(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All columns of df with shard and slot: what a writer needs. Rows equal in id, size and CRC are ordered by a hash of all their columns, so reruns agree. Columns may have any name; those named shard or slot give way to the result's."""
    session(df.sparkSession)
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = df.select(F.struct(*own).alias("row"), F.col("doc_id").alias("id"), F.crc32(F.encode(body, "UTF-8")).alias("crc"), F.octet_length(body).alias("size"), F.xxhash64(*[c for c in hashable(df) if c in own]).alias("rest"))
    rows, n = ranked(keyed, ["id", "crc", "size", "rest"])

    @F.pandas_udf("long")
    def placed(rank: pd.Series) -> pd.Series:
        return pd.Series(place(rank.to_numpy(), n, seed))

    return rows.withColumn("place", placed("_rank")).select("row.*", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").cast("long").alias("slot"))
