"""Named queries: each binds an operator to the given tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: F.Column) -> F.Column:
    """A frozen split by key: 0-7 train, 8 val, 9 test."""
    m = F.pmod(key, F.lit(10))
    return F.when(m < 8, "train").when(m == 8, "val").otherwise("test")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, label (the language), split."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"), split_of(F.col("doc_id")).alias("split"))


#: The same in SQL.
CORPUS = "corpus AS (SELECT doc_id, text, lang AS label, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)"
TOKENS = CORPUS + r", tokens AS (SELECT doc_id, label, split, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS token FROM corpus)"
ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
