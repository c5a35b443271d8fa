"""Seeded demo data and file sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of shoppers and what they tend to buy.
KINDS = {"breakfast": ["milk", "bread", "eggs", "coffee", "butter"], "salad": ["tomato", "lettuce", "onion", "oil", "pepper"], "sweet": ["chocolate", "cookies", "icecream", "soda"], "dinner": ["pasta", "sauce", "cheese", "wine"]}


def baskets(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(order_id, items): each order has a kind; its goods come in with a chance of 0.6 each, any other with 0.05."""
    u = lambda tag: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(tag)), F.lit(1_000_003)) / 1_000_003.0
    kind = F.floor(u("kind") * len(KINDS))
    goods = [F.when(u(g) < F.when(kind == i, 0.6).otherwise(0.05), g) for i, (_, gs) in enumerate(KINDS.items()) for g in gs]
    return spark.range(n).select(F.col("id").alias("order_id"), F.array_compact(F.array(*goods)).alias("items")).where("size(items) > 0")


def trips(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Trips within the city's bounds, longer at rush hours."""
    u = lambda k: F.rand(seed + k)
    x = spark.range(n).select(
        "id", (F.lit(-74.02) + 0.2 * u(1)).alias("lon1"), (F.lit(40.65) + 0.2 * u(2)).alias("lat1"), (F.lit(-74.02) + 0.2 * u(3)).alias("lon2"), (F.lit(40.65) + 0.2 * u(4)).alias("lat2"),
        F.timestamp_seconds(F.lit(1451606400) + F.floor(u(5) * 15_552_000)).alias("started"), (1 + F.floor(u(6) * 6)).cast("int").alias("riders"), (1 + F.floor(u(7) * 2)).cast("int").alias("vendor"),
    )
    km = 111 * (F.abs(F.col("lat1") - F.col("lat2")) + 0.76 * F.abs(F.col("lon1") - F.col("lon2")))
    rush = F.hour("started").between(7, 10) | F.hour("started").between(16, 19)
    return x.withColumn("seconds", F.greatest(F.lit(60.0), 120 + km * F.when(rush, 220).otherwise(150) + 60 * F.randn(seed)))


def artifact_size(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path and their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
