"""The corpus pipeline: toxicity, one document of each near-duplicate group, decontamination, source mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as Parquet before the next
reads it. All but the last return the columns of documents; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from granary.llm.common import written
from granary.llm.queries import table, toxicity_model

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (learned from the labelled rows) scores 0.5 or more go."""
    return toxicity.clean_rows(docs, toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a similarity of 0.8 or more the one with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice."""
    return mixing.mix_rows(docs, table(spark, sf_dir, "labels"))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot by a keyed permutation of all rows."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: A learned score, components and CRC32 have no SQL form: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
