"""Frequent itemsets, association and class rules, recommendations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.quantiles import quantiles
from granary.sources.store import drop_written, numbered, released, written

CLAMP = 1e-6


def items_of(df: DataFrame, tid: str, item: str) -> DataFrame:
    """Distinct (tid, item)."""
    return df.where(F.col(item).isNotNull()).select(F.col(tid).alias("tid"), F.col(item).alias("item")).distinct()


def supports_by_pairs(items: DataFrame) -> DataFrame:
    """Support of each pair of items that occur together, by intersecting their transactions' bitmaps."""
    return eclat(items, 1, 2).where("size = 2").select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "n")


def frequent_itemsets(items: DataFrame, min_support: float, max_len: int = 3, n: int | None = None) -> DataFrame:
    """(items sorted, size, n, support) of itemsets in at least ceil(min_support * transactions), level by level.

    Each transaction keeps its frequent items only; pairs come from its own (sorted) array, and triples from its frequent
    pairs with one first item, if their other pair is frequent too. Counts are aggregated before the shuffle."""
    if not 1 <= max_len <= 3:
        raise ValueError("max_len must be 1, 2 or 3")
    items = written(items.select("tid", "item"), "items")
    total = items.select("tid").distinct().agg(F.count("*").alias("total"))
    least = F.ceil(F.lit(min_support) * F.col("total") - F.lit(1e-9))
    one = items.groupBy("item").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= least)
    one = written(one, "level1")
    levels = [one.select(F.array("item").alias("items"), F.lit(1).alias("size"), "n", "total")]
    rows = items.join(one.select("item"), "item").groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("w"))  # a transaction's own items
    if max_len > 1:
        rows = written(rows, "baskets")
        pairs = rows.where("size(w) > 1").select(F.explode(F.expr("flatten(transform(w, (x, i) -> transform(slice(w, i + 2, size(w)), y -> array(x, y))))")).alias("items"))
        two = pairs.groupBy("items").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= least)
        two = written(two, "level2")
        levels.append(two.select("items", F.lit(2).alias("size"), "n", "total"))
    if max_len > 2:
        known = two.select("items")
        own = rows.where("size(w) > 2").select("tid", F.explode(F.expr("flatten(transform(w, (x, i) -> transform(slice(w, i + 2, size(w)), y -> array(x, y))))")).alias("items")).join(known, "items", "left_semi")
        fans = own.groupBy("tid", F.col("items")[0].alias("x")).agg(F.array_sort(F.collect_list(F.col("items")[1])).alias("ys")).where("size(ys) > 1")
        triples = fans.select(F.explode(F.expr("flatten(transform(ys, (y, i) -> transform(slice(ys, i + 2, size(ys)), z -> array(x, y, z))))")).alias("items"))
        three = triples.groupBy("items").agg(F.count("*").alias("n"))
        three = three.join(known.select(F.col("items").alias("_k")), F.array(F.col("items")[1], F.col("items")[2]) == F.col("_k"), "left_semi")
        three = three.crossJoin(F.broadcast(total)).where(F.col("n") >= least)
        levels.append(three.select("items", F.lit(3).alias("size"), "n", "total"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.withColumn("support", F.col("n") / F.col("total"))


def rules(itemsets: DataFrame, min_confidence: float = 0.0, min_lift: float = 0.0) -> DataFrame:
    """Every proper split of each itemset: support, confidence, lift, leverage, conviction (its denominator at least 1e-6)."""
    whole = itemsets.where("size > 1").select("items", "n", "total")
    subsets = F.expr("if(size(items) = 2, transform(items, x -> array(x)), concat(transform(items, x -> array(x)), transform(items, x -> array_except(items, array(x)))))")
    split = whole.withColumn("antecedent", F.explode(subsets)).withColumn("consequent", F.expr("array_except(items, antecedent)"))
    known = itemsets.select("items", "n")
    a, c = known.select(F.col("items").alias("antecedent"), F.col("n").alias("na")), known.select(F.col("items").alias("consequent"), F.col("n").alias("nc"))
    x = split.drop("items").join(a, "antecedent").join(c, "consequent")
    s, sa, sc = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nc") / F.col("total")
    x = x.withColumn("confidence", F.col("n") / F.col("na")).withColumn("lift", F.col("n") / F.col("na") / sc)
    x = x.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    return x.select(
        "antecedent", "consequent", s.alias("support"), "confidence", "lift", (s - sa * sc).alias("leverage"),
        ((1 - sc) / F.greatest(1 - F.col("confidence"), F.lit(CLAMP))).alias("conviction"),
    )


def best_rules(rule_table: DataFrame, k: int = 250) -> DataFrame:
    """The first k by lift, then confidence, then items (rule_rank from 1). Lift and confidence count at 9 places, so equal ones tie."""
    top = rule_table.orderBy(F.round("lift", 9).desc(), F.round("confidence", 9).desc(), "antecedent", "consequent").limit(k)
    return top.withColumn("rule_rank", F.row_number().over(W.orderBy(F.round("lift", 9).desc(), F.round("confidence", 9).desc(), "antecedent", "consequent")))


def recommend(baskets: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """For each basket (tid, items array) the k consequents of highest lift among rules whose antecedent it holds; per item its best rule counts.

    Antecedents of one or two items are looked up by equality with the basket's own singles and pairs."""
    own = F.expr("concat(transform(items, x -> array(x)), flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> array(x, y)))))")
    keys = baskets.select("tid", "items", F.explode(own).alias("antecedent"))
    hit = keys.join(F.broadcast(ranked), "antecedent").select("tid", "items", "rule_rank", "lift", "confidence", F.explode("consequent").alias("item")).where(~F.array_contains("items", F.col("item")))  # ranked: a bounded report of rules
    best = hit.groupBy("tid", "item").agg(F.min(F.struct("rule_rank", "lift", "confidence")).alias("r"))
    w = W.partitionBy("tid").orderBy("r.rule_rank", "item")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("tid", "rank", "item", F.col("r.lift").alias("lift"), F.col("r.confidence").alias("confidence"))


def class_rules(items: DataFrame, labels: DataFrame, min_docs: int = 30, max_len: int = 2) -> DataFrame:
    """Itemset -> class for every class that occurs with it: (items, size, support_docs, label, matching, confidence, lift over the class's share). labels: (tid, label)."""
    prior = labels.groupBy("label").agg(F.count("*").alias("c")).withColumn("prior", F.col("c") / F.sum("c").over(W.partitionBy())).drop("c")
    frequent = items.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("item")
    rows = items.join(frequent, "item").groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("w")).join(labels, "tid")
    sets = "transform(w, x -> array(x))"
    if max_len > 1:
        sets = f"concat({sets}, flatten(transform(w, (x, i) -> transform(slice(w, i + 2, size(w)), y -> array(x, y)))))"
    by = rows.select("label", F.explode(F.expr(sets)).alias("items")).groupBy("items", "label").agg(F.count("*").alias("matching"))
    by = by.withColumn("support_docs", F.sum("matching").over(W.partitionBy("items"))).where(F.col("support_docs") >= min_docs)
    conf = F.col("matching") / F.col("support_docs")
    return by.join(F.broadcast(prior), "label").select("items", F.size("items").alias("size"), "support_docs", "label", "matching", F.round(conf, 6).alias("confidence"), F.round(conf / F.col("prior"), 6).alias("lift"))


def pairs_vs_singletons(class_rule_table: DataFrame) -> DataFrame:
    """Each pair's strongest rule against the better of its two items' strongest: the gain and whether the predicted class changed. Ties go to the class first in name, and to the first item."""
    best = class_rule_table.withColumn("_n", F.row_number().over(W.partitionBy("items").orderBy(F.desc("confidence"), "label"))).where("_n = 1")
    one = best.where("size = 1").select(F.col("items")[0].alias("item"), F.col("label").alias("l"), F.col("confidence").alias("c"))
    a, b = (one.select(*[F.col(x).alias(f"{x}_{s}") for x in ("item", "l", "c")]) for s in "ab")
    x = best.where("size = 2").join(a, F.col("items")[0] == F.col("item_a")).join(b, F.col("items")[1] == F.col("item_b"))
    first = F.col("c_a") >= F.col("c_b")
    parent = F.when(first, F.col("c_a")).otherwise(F.col("c_b"))
    return x.select("items", "label", "confidence", "support_docs", F.when(first, F.col("item_a")).otherwise(F.col("item_b")).alias("best_parent"), parent.alias("parent_confidence"), F.round(F.col("confidence") - parent, 6).alias("gain"), (F.col("label") != F.when(first, F.col("l_a")).otherwise(F.col("l_b"))).alias("changed"))


def gain_summary(compared: DataFrame) -> DataFrame:
    compared = written(compared.select("gain", "changed"), "compared")
    mid = quantiles(compared, {"m": F.col("gain")}, [0.5]).select(F.round(F.col("m")[0], 6).alias("median_gain"))
    one = compared.agg(F.count("*").alias("n_pairs"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.avg((F.col("gain") > 0).cast("int")), 6).alias("better"), F.round(F.avg((F.col("gain") > 0.1).cast("int")), 6).alias("over_10_points"), F.round(F.avg(F.col("changed").cast("int")), 6).alias("changing"))
    return one.crossJoin(F.broadcast(mid)).select("n_pairs", "mean_gain", "median_gain", "better", "over_10_points", "changing")  # one row each


def rule_graph(itemsets: DataFrame, rule_table: DataFrame, nodes: int = 16, links: int = 24) -> DataFrame:
    """Links between the most frequent items: the first rules of one item to one, ranked among all such rules."""
    top = itemsets.where("size = 1").orderBy(F.desc("n"), "items").limit(nodes).select(F.col("items")[0].alias("item"))
    x = rule_table.where("size(antecedent) = 1 and size(consequent) = 1").select(F.col("antecedent")[0].alias("source"), F.col("consequent")[0].alias("target"), "lift", "confidence")
    x = numbered(x, [F.round("lift", 9).desc(), F.round("confidence", 9).desc(), F.col("source"), F.col("target")], "rule_rank")
    x = x.join(top.withColumnRenamed("item", "source"), "source", "left_semi").join(top.withColumnRenamed("item", "target"), "target", "left_semi")
    return x.select("source", "target", F.round("lift", 6).alias("lift"), F.col("rule_rank").cast("int").alias("rule_rank")).orderBy("rule_rank").limit(links)


def threshold_sweep(itemsets: DataFrame, rule_table: DataFrame, grid: list[float]) -> DataFrame:
    """Itemsets and rules at each support of a grid, from one mining pass at its least."""
    g = F.explode(F.array(*[F.lit(x) for x in grid])).alias("min_support")
    a = itemsets.select("support", g).where("support >= min_support").groupBy("min_support").agg(F.count("*").alias("itemsets"))
    b = rule_table.select("support", g).where("support >= min_support").groupBy("min_support").agg(F.count("*").alias("rules"))
    return a.join(b, "min_support", "left").na.fill(0, ["rules"])


def fpgrowth_itemsets(items: DataFrame, min_support: float) -> DataFrame:
    """The same itemsets from Spark's FP-growth, as a second algorithm."""
    from pyspark.ml.fpm import FPGrowth

    rows = items.groupBy("tid").agg(F.collect_set("item").alias("items"))
    return FPGrowth(minSupport=min_support, itemsCol="items").fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("n"))


# ---- bitmaps of transactions ----

#: Bits of a bitmap row, as Spark's bitmap functions cut them; items that meet in one task, at most.
BITS, ITEM_BLOCK = 32768, 1024


def tid_bitmaps(items: DataFrame) -> DataFrame:
    """items(tid, item), distinct: (item, chunk, bits), the transactions of each item as bitmaps of 32,768 numbered transactions."""
    tids = numbered(items.select("tid").distinct(), ["tid"], "_t")
    x = items.join(tids, "tid")
    return x.groupBy("item", F.expr("bitmap_bucket_number(_t)").alias("chunk")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_t))").alias("bits"))


def _counted(level: DataFrame, n_items: int, block: int) -> DataFrame:
    """level(prefix, last, chunk, bits): (prefix, a, b, n), the common bits of each two itemsets with one prefix. Blocks of items meet in pairs, a chunk at a time; counts are added up before they move."""
    blocks = max(1, -(-n_items // block))
    own = F.pmod(F.xxhash64("last"), F.lit(blocks)).cast("int")
    x = level.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.select("prefix", "last", "chunk", "bits", F.least("_b", "_o").alias("x"), F.greatest("_b", "_o").alias("y"), (F.col("_b") > F.col("_o")).alias("second"))

    def met(t: pa.Table) -> pa.Table:
        last, second = np.asarray(t["last"]), np.asarray(t["second"])
        words = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(last), -1)
        inner = not second.any()
        first, other = np.flatnonzero(~second), np.arange(len(last)) if inner else np.flatnonzero(second)
        out = [np.zeros((0, 3), np.int64)]
        if inner and t["x"][0] != t["y"][0]:  # the other block is empty here
            first = first[:0]
        for i in first:
            js = other[last[other] > last[i]] if inner else other
            n = np.bitwise_count(words[js] & words[i]).sum(1, dtype=np.int64)
            hit = js[n > 0]
            out.append(np.stack([np.minimum(last[hit], last[i]), np.maximum(last[hit], last[i]), n[n > 0]], 1))
        a, b, n = np.concatenate(out).T
        return pa.table({"prefix": pa.array([t["prefix"][0].as_py()] * len(a), pa.list_(pa.int64())), "a": a, "b": b, "n": n})

    met_ = x.groupBy("prefix", "chunk", "x", "y").applyInArrow(met, "prefix array<long>, a long, b long, n long")
    return met_.groupBy("prefix", "a", "b").agg(F.sum("n").alias("n"))


def _and(batches):
    for t in batches:
        bits = [(np.frombuffer(a, np.uint64) & np.frombuffer(b, np.uint64)).tobytes() for a, b in zip(t["bits"].to_pylist(), t["_bits"].to_pylist(), strict=True)]
        keep = pa.array([any(x) for x in bits], pa.bool_())
        out = pa.RecordBatch.from_arrays([t["prefix"], t["last"], t["chunk"], pa.array(bits, pa.binary())], ["prefix", "last", "chunk", "bits"])
        yield out.filter(keep)


def eclat(items: DataFrame, least: int, max_len: int | None = None, block: int = ITEM_BLOCK) -> DataFrame:
    """(items sorted, size, n): the itemsets of any length (of max_len at most) in at least `least` transactions, by intersecting bitmaps.

    items(tid, item): distinct and without nulls. A level holds the bitmaps of its frequent itemsets; two that differ in their last item only
    are intersected, first to count and, where the count suffices, for the next level. A task holds the bitmaps of two blocks of items for
    one chunk of transactions, so neither a long transaction nor a frequent item is gathered."""
    if least < 1 or (max_len is not None and max_len < 1):
        raise ValueError("least and max_len must be 1 or more")
    spark = items.sparkSession
    items = written(items.select("tid", "item"), "items")
    one = numbered(items.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least), ["item"], "last")  # numbers in the items' order
    one = written(one, "frequent")
    n_items, size = one.count(), 1
    found = [one.select(F.array("last").alias("ids"), "n")]
    level = written(tid_bitmaps(items).join(one, "item").select(F.array().cast("array<long>").alias("prefix"), "last", "chunk", "bits"), "bitmaps")
    while max_len is None or size < max_len:
        pairs = written(_counted(level, n_items, block).where(F.col("n") >= least), "pairs")
        if pairs.isEmpty():
            break
        size += 1
        found.append(pairs.select(F.concat("prefix", F.array("a", "b")).alias("ids"), "n"))
        if size == max_len:
            break
        a = level.select("prefix", F.col("last").alias("a"), "chunk", "bits")
        b = level.select("prefix", F.col("last").alias("b"), "chunk", F.col("bits").alias("_bits"))
        both = pairs.drop("n").join(a, ["prefix", "a"]).join(b, ["prefix", "b", "chunk"])
        both = both.select(F.concat("prefix", F.array("a")).alias("prefix"), F.col("b").alias("last"), "chunk", "bits", "_bits")
        deeper = written(both.mapInArrow(_and, level.schema), "bitmaps")
        drop_written(level)
        level = deeper
    drop_written(level)
    released(spark)
    ids = found[0]
    for x in found[1:]:
        ids = ids.unionByName(x)
    named = ids.select("ids", "n", F.posexplode("ids").alias("_p", "last")).join(one.select("last", "item"), "last")
    named = named.groupBy("ids").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("_p", "item"))).alias("w"))  # an itemset's own items
    return named.select(F.col("w.item").alias("items"), F.size("ids").alias("size"), "n")
