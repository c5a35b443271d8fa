"""Outlier flags of texts, slices, and subgroup profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import n_tokens
from granary.operators.quantiles import quantiles
from granary.operators.vocab import log_odds, token_rows, top_k
from granary.sources.store import written

CUE_Z, CUES_PER_CLASS, SHORT = 3.0, 150, 5
#: Tokens are rare up to two occurrences; `flags` finds their documents as the first and the last, so it isn't a parameter.
RARE = 2


def cue_lexicon(counts: DataFrame, label: str = "label", z: float = CUE_Z, per_class: int = CUES_PER_CLASS) -> DataFrame:
    """Tokens that some class overuses clearly: at most `per_class` a class."""
    return top_k(log_odds(counts, label).where(F.col("z") >= z), per_class, [label], F.desc("z"), "token").select("token").distinct()


def tukey(df: DataFrame, value: Column) -> DataFrame:
    """One row: quartiles and the fences 1.5 interquartile ranges beyond them."""
    q = quantiles(df, {"q": value}, [0.25, 0.75])
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[0] - 1.5 * iqr).alias("lower_fence"), (F.col("q")[1] + 1.5 * iqr).alias("upper_fence"))


def flags(df: DataFrame, template: str, doc: str = "doc_id", label: str = "label", text: str = "text") -> DataFrame:
    """Per document: words, cue words, share of rare words, and the five flags: short, long, off template, heavy in rare words, free of cues."""
    words = n_tokens(F.col(text))
    ends = [F.sum("n").alias("n"), F.sum("known").alias("known"), F.min("first").alias("first"), F.max("last").alias("last")]
    one = token_rows(df, doc, label, text=text).select(label, "token", F.lit(1).alias("n"), F.col(doc).isNotNull().cast("int").alias("known"), F.col(doc).alias("first"), F.col(doc).alias("last"))
    counts = written(one.groupBy(label, "token").agg(*ends), "counts")
    lexicon = cue_lexicon(counts.select(label, "token", "n"), label).withColumn("cue", F.lit(1))
    # A token of two occurrences lies in its first and its last document, so no document meets its tokens' frequencies in a join.
    rare = counts.groupBy("token").agg(*ends).where(F.col("n") <= RARE).select(F.explode(F.slice(F.array("first", "last"), 1, F.col("known").cast("int"))).alias(doc))
    rare = rare.groupBy(doc).agg(F.count("*").alias("n_rare"))
    cues = token_rows(df, doc, text=text).join(F.broadcast(lexicon), "token", "left")  # 150 tokens a class at most
    cues = cues.groupBy(doc).agg(F.count("*").alias("n"), F.count("cue").alias("n_cues"))
    sums = cues.join(rare, doc, "left").select(doc, "n_cues", (F.coalesce("n_rare", F.lit(0)) / F.col("n")).alias("rare_share"))
    x = df.select(doc, label, words.alias("n_words"), (~F.col(text).rlike(template)).alias("is_off_template")).join(sums, doc, "left").na.fill(0, ["n_cues"]).na.fill(0.0, ["rare_share"])
    x = written(x, "shares")
    cuts = quantiles(x, {"q": F.col("n_words"), "rare_cut": F.col("rare_share")}, [0.25, 0.75, 0.99]).select("q", F.col("rare_cut")[2].alias("rare_cut"))
    y = x.crossJoin(F.broadcast(cuts))  # one row
    made = y.select(
        doc, label, "n_words", "n_cues", F.round("rare_share", 6).alias("rare_share"), (F.col("n_words") <= SHORT).alias("is_short"),
        (F.col("n_words") >= F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("is_long"), "is_off_template",
        (F.col("rare_share") >= F.col("rare_cut")).alias("is_rare_heavy"), (F.col("n_cues") == 0).alias("is_cue_free"),
    )
    names = ["is_short", "is_long", "is_off_template", "is_rare_heavy", "is_cue_free"]
    return made.withColumn("n_flags", sum((F.col(c).cast("int") for c in names), F.lit(0)))


def flag_overlap(flagged: DataFrame) -> DataFrame:
    n = F.col("n_flags")
    return flagged.agg(F.count_if(n == 0).alias("none"), F.count_if(n == 1).alias("one"), F.count_if(n >= 2).alias("two_plus"), F.count_if(n >= 3).alias("three_plus"))


def class_profile(df: DataFrame, inside: Column, label: str = "label") -> DataFrame:
    """Class shares of a subgroup and their lift over the whole."""
    x = df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_in"))
    w = W.partitionBy()
    share = F.col("n_in") / F.sum("n_in").over(w)
    return x.select(label, "n_in", F.round(share, 6).alias("share"), F.round(share / (F.col("n") / F.sum("n").over(w)), 6).alias("lift"))


def bucket_coverage(flagged: DataFrame, edges=(5, 10, 20, 40, 80)) -> DataFrame:
    """Fixed buckets of length: rows, share with a cue, mean cues."""
    b = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        b = F.when(F.col("n_words") <= edges[i], i).otherwise(b)
    return flagged.groupBy(b.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("n_cues") > 0).cast("int")), 6).alias("with_cue"), F.round(F.avg("n_cues"), 6).alias("mean_cues"))
