"""Duplicates, leakage between splits, label conflicts and the cleaning policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import squash
from granary.sources.store import written


def hashed(text: Column | str) -> Column:
    """A text's key: texts themselves are never shuffled or sorted. Null stays null."""
    return F.sha2(text, 256)


def duplicates_within(df: DataFrame, split: str = "split", text: str = "text", label: str = "label") -> DataFrame:
    """Per split: rows, distinct texts, repeated texts, redundant rows, and repeated texts with one or several labels. Null texts count as rows only."""
    key = hashed(text)
    each = df.groupBy(split, key.alias("_h"), label).agg(F.count("*").alias("_n"))  # copies of a text are counted before they move
    g = each.groupBy(split, "_h").agg(F.sum("_n").alias("n"), F.count(label).alias("labels"))
    known = F.col("_h").isNotNull()
    again = known & (F.col("n") > 1)
    return g.groupBy(split).agg(
        F.sum("n").alias("n_rows"), F.count_if(known).alias("distinct_texts"), F.count_if(again).alias("repeated_texts"),
        F.sum(F.when(again, F.col("n") - 1).otherwise(0)).alias("redundant_rows"),
        F.count_if(again & (F.col("labels") == 1)).alias("one_label"), F.count_if(again & (F.col("labels") > 1)).alias("conflicting"),
    )


def first_per_text(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """The first row of each text in a total order: a partial aggregate, so copies of one text don't meet."""
    return _firsts(df.where(F.col(text).isNotNull()), order, text).select("first.row.*")


def _firsts(df: DataFrame, order: str, text: str) -> DataFrame:
    """(h, first): the first row of each text, a null one included, by the texts' SHA-256."""
    least = F.min(F.struct(F.col(order).alias("o"), F.struct("*").alias("row")))
    return df.groupBy(hashed(text).alias("h")).agg(least.alias("first"))


def overlap(df: DataFrame, a: str, b: str, order: str = "doc_id", split: str = "split", text: str = "text", label: str = "label") -> DataFrame:
    """Shared distinct texts of two splits, rows of b that they touch, and shared texts whose first labels agree."""
    x = df.where(F.col(split).isin(a, b) & F.col(text).isNotNull()).select(hashed(text).alias("h"), F.col(split).alias("s"), F.struct(F.col(order).alias("o"), F.col(label).alias("l")).alias("r"))
    first = lambda s: F.min(F.when(F.col("s") == s, F.col("r")))
    per = x.groupBy("h").agg(first(a).alias("ra"), first(b).alias("rb"), F.count_if(F.col("s") == b).alias("n")).where("ra is not null and rb is not null")
    same = F.col("ra.l") == F.col("rb.l")
    return per.agg(F.count("*").alias("shared_texts"), F.count_if(same).alias("same_label"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_touched")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "shared_texts", "same_label", "rows_touched")


def label_sets(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(h, labels): SHA-256 of texts with more than one label, and the sorted set (a class has one entry, so it is small)."""
    return df.where(F.col(text).isNotNull()).groupBy(hashed(text).alias("h")).agg(F.sort_array(F.collect_set(label)).alias("labels")).where(F.size("labels") > 1)


def contradictions(df: DataFrame, test: str, split: str = "split", text: str = "text", label: str = "label") -> DataFrame:
    """Conflicting texts, rows of the test split among them, and the accuracy that no classifier of texts can pass: every text answered by its most frequent label."""
    sets = label_sets(df, text, label)
    per = df.where(F.col(text).isNotNull()).groupBy(hashed(text).alias("h"), label).agg(F.count("*").alias("n")).groupBy("h").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    ceiling = per.agg(F.round(F.sum("best") / F.sum("n"), 6).alias("accuracy_ceiling"))
    tested = df.where(F.col(split) == test).select(hashed(text).alias("h")).distinct().join(sets, "h", "left_semi").agg(F.count("*").alias("test_texts_contradicted"))
    return sets.agg(F.count("*").alias("conflicting_texts")).crossJoin(tested).crossJoin(ceiling)


def pair_enrichment(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Observed label pairs of conflicting texts against what class sizes alone give."""
    share = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))
    share = share.withColumn("denom", 1 - F.sum(F.col("p") * F.col("p")).over(W.partitionBy()))
    sets = label_sets(df, text, label)
    seen = sets.where(F.size("labels") == 2).groupBy(F.col("labels")[0].alias("a"), F.col("labels")[1].alias("b")).agg(F.count("*").alias("observed"))
    total = sets.agg(F.count("*").alias("total"))
    grid = share.select(F.col(label).alias("a"), F.col("p").alias("pa"), "denom").crossJoin(F.broadcast(share.select(F.col(label).alias("b"), F.col("p").alias("pb")))).where("a < b")
    x = grid.join(F.broadcast(seen), ["a", "b"], "left").na.fill(0, ["observed"]).crossJoin(F.broadcast(total))
    expected = 2 * F.col("pa") * F.col("pb") / F.col("denom")
    ratio = F.when(F.col("total") > 0, F.col("observed") / F.col("total") / expected)
    return x.select("a", "b", "observed", F.round(expected, 6).alias("expected_share"), F.round(ratio, 6).alias("enrichment"))


def clean(df: DataFrame, order: str = "doc_id", split: str = "split", text: str = "text", label: str = "label", train: str = "train") -> tuple[DataFrame, DataFrame]:
    """The training rows that stay, and how many each rule removed, in order: A texts that held-out splits have; B, among what is left, all copies of texts with several labels; C repeats but the first. Held-out rows never change."""
    # What a text's copies hold together decides, and is aggregated before it moves: copies of a hot text never meet.
    trains = F.col(split) == train
    seen = df.select(hashed(text).alias("h"), F.col(label).alias("l"), trains.alias("t"), (F.col(split) != train).alias("held"))
    each = seen.groupBy("h", "l").agg(F.count_if("t").alias("n"), F.max(F.coalesce("held", F.lit(False))).alias("held"))
    per = each.groupBy("h").agg(F.sum("n").alias("n"), F.max("held").alias("held"), F.count(F.when(F.col("n") > 0, F.col("l"))).alias("k")).where("n > 0")
    known = F.col("h").isNotNull()
    leaks, conflicts = known & F.col("held"), known & (F.col("k") > 1)
    per = written(per.select("h", "n", F.when(leaks, "a").when(conflicts, "b").otherwise("c").alias("rule")), "texts")
    c = _firsts(df.where(trains), order, text).join(per.where("rule = 'c'").select(F.col("h").alias("_h")), F.col("h").eqNullSafe(F.col("_h")), "left_semi").select("first.row.*")
    rows = lambda r: F.coalesce(F.sum(F.when(F.col("rule").isin(*r), F.col("n"))), F.lit(0))
    counts = per.agg(rows("abc").alias("before"), rows("bc").alias("_a"), rows("c").alias("_b"), F.count_if(F.col("rule") == "c").alias("after"))
    return c, counts.select("before", (F.col("before") - F.col("_a")).alias("leakage"), (F.col("_a") - F.col("_b")).alias("conflicting"), (F.col("_b") - F.col("after")).alias("redundant"), "after")


def conflict_elsewhere(a: DataFrame, b: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows of a whose text has another label in b."""
    other = b.select(hashed(text).alias("_h"), F.col(label).alias("_other")).distinct()
    return a.join(other, (hashed(a[text]) == other["_h"]) & (a[label] != other["_other"]), "left_semi")


def changed_by_normalizing(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(squash(F.col(text)) != F.col(text)).alias("changed"))


def contained(df: DataFrame, probes: DataFrame, text: str = "text", probe: str = "text") -> DataFrame:
    """Rows of df with a probe text in them: probes (a small table, broadcast while its size allows) are searched as literals."""
    p = probes.where(F.length(probe) > 0).select(F.col(probe).alias("_p")).distinct()
    return df.join(p, F.col(text).contains(F.col("_p")), "left_semi")
