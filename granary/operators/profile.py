"""Profiles of tables: structure, labels, drift, characters, sizes, contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import char_class, n_tokens
from granary.operators.quantiles import quantiles
from granary.sources.store import written


def structure(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, blanks (strings of white space only), in one pass."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns], *[(F.count_if(F.trim(c) == "") if kinds[c] == "string" else F.lit(0).cast("long")).alias(f"b_{c}") for c in df.columns])
    pairs = ", ".join(f"'{c}', '{kinds[c]}', n_{c}, b_{c}" for c in df.columns)
    return one.selectExpr("rows", f"stack({len(df.columns)}, {pairs}) AS (column_name, dtype, nulls, blanks)")


def label_distribution(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Count and share of each class in each split, the majority class, and the largest count over the smallest."""
    w = W.partitionBy(split)
    x = df.groupBy(split, label).agg(F.count("*").alias("n"))
    return x.select(
        split, label, "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"),
        F.max(F.struct("n", label)).over(w)[label].alias("majority"), F.round(F.max("n").over(w) / F.min("n").over(w), 6).alias("imbalance"),
    )


def drift(df: DataFrame, base: str, split: str = "split", label: str = "label") -> DataFrame:
    """Total variation distance and largest difference of class shares of each split from the base split; classes that are missing count as 0."""
    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(split))).drop("n")
    grid = df.select(split).distinct().crossJoin(F.broadcast(df.select(label).distinct()))  # splits by classes: both few
    full = grid.join(shares, [split, label], "left").na.fill(0.0, ["p"])
    ref = full.where(F.col(split) == base).select(label, F.col("p").alias("q"))
    return full.where(F.col(split) != base).join(F.broadcast(ref), label).groupBy(split).agg(F.round(0.5 * F.sum(F.abs(F.col("p") - F.col("q"))), 6).alias("tvd"), F.round(F.max(F.abs(F.col("p") - F.col("q"))), 6).alias("max_diff"))


def chars(df: DataFrame, text: str = "text") -> DataFrame:
    """Each character's count with its class, most frequent first."""
    return df.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n")).withColumn("cls", char_class(F.col("ch")))


def char_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """Characters of each class, by counting once for each distinct character."""
    return chars(df, text).groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_chars"))


def rows_with(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Per named test the rows that meet it, in one pass."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in tests.items()])
    return one.selectExpr(f"stack({len(tests)}, {', '.join(f'''{k!r}, {k}''' for k in tests)}) AS (test, n_rows)")


def size_summary(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    x = written(df.select(*by, F.length(text).alias("chars"), n_tokens(F.col(text)).alias("words")), "sizes")
    sizes = ("chars", "words")
    mid = quantiles(x, {c: F.col(c) for c in sizes}, [0.5], by)
    g = x.groupBy(*by).agg(*[f(c).alias(f"{k}_{c}") for c in sizes for k, f in (("min", F.min), ("mean", lambda c: F.round(F.avg(c), 6)), ("max", F.max))])
    g = g.join(mid.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(c)[0].alias(f"median_{c}") for c in sizes]), reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True)))
    return g.select(*by, *[f"{k}_{c}" for c in sizes for k in ("min", "median", "mean", "max")])


PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def length_describe(df: DataFrame, by: str = "label", text: str = "text", value: Column | None = None) -> DataFrame:
    """Over all (label `*`) and per class: n, min, max, mean, sample deviation, percentiles and Pearson's second skewness (0 without deviation)."""
    x = written(df.select(by, (n_tokens(F.col(text)) if value is None else value).alias("v")), "lengths")
    g = x.groupingSets([[], [by]], by).agg(F.grouping(by).alias("all"), F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    sums = x.groupBy(by, "v").agg(F.count("*").alias("n"))
    none = F.lit(None).cast(x.schema[by].dataType)
    both = sums.select(F.col(by).alias("_by"), F.lit(0).alias("_all"), "v", "n").unionByName(sums.select(none.alias("_by"), F.lit(1).alias("_all"), "v", "n"))
    p = quantiles(both, {"p": F.col("v")}, PERCENTILES, ["_by", "_all"], F.col("n"))
    g = g.join(p, F.col(by).eqNullSafe(F.col("_by")) & (F.col("all") == F.col("_all")), "left")
    sd = F.coalesce("s", F.lit(0.0))
    skew = F.when(sd > 0, 3 * (F.col("m") - F.col("p")[3]) / sd).otherwise(0.0)
    return g.select(F.when(F.col("all") == 1, "*").otherwise(F.col(by)).alias("cls"), "n", "min", "max", F.round("m", 6).alias("mean"), F.round(sd, 6).alias("sd"), *[F.round(F.col("p")[i], 6).alias(f"p{round(q * 100):02d}") for i, q in enumerate(PERCENTILES)], F.round(skew, 6).alias("skew"))


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Fixed-width bins over lo..hi (the last edge belongs to the last bin), as counts and density among values in range."""
    w = (hi - lo) / bins
    x = df.select(value.cast("double").alias("v")).where(F.col("v").between(lo, hi))
    b = x.select(F.least(F.floor((F.col("v") - lo) / w), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return b.withColumn("density", F.round(F.col("n") / (F.sum("n").over(W.partitionBy()) * w), 8))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Contract check: rules whose condition fails (or is null) for some rows, with their numbers."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return one.selectExpr(f"stack({len(rules)}, {', '.join(f'''{k!r}, {k}''' for k in rules)}) AS (rule, n_bad)")


def assert_contract(df: DataFrame, rules: dict[str, Column]) -> None:
    bad = violations(df, rules).where("n_bad > 0").collect()  # a row for each rule
    if bad:
        raise ValueError("contract broken: " + ", ".join(f"{r['rule']} by {r['n_bad']} rows" for r in bad))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
