"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each row gets the key -ln(u) / weight, with u in (0, 1) from a hash of its id, text and seed and weight from the
quality label (an exponential key: the smallest keys are a weighted sample without replacement). A source's target
is its share of `share` times all words, at most `cap` times the source's own words, the excess going to the others by
weight until none is above. A source takes floor(target / words) whole epochs of every row, then rows in the order of
their keys while the running sum of words stays within the rest; the row at the boundary comes in where that ends
nearer to the target, so a source ends within half of one row of it.

The order within a source never needs one task: keys fall into bands, the bands' sums tell the band of the boundary,
and only the rows of that band are sorted, by source. Null sources are a source of their own (the last). Null texts
and texts without words have size 0 and are taken 0 times. Repeated rows are rows like others; where all that orders
them is equal they are interchangeable. Labels may repeat: the largest quality of an id counts. A row without one has weight 1. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import hashable, unit_hash, written

#: Weights of the sources, in the order of their names, repeating; words to take, of all; most epochs of a source; words to a row's weight, by quality.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
QUALITY_WEIGHT = {0: 0.5, 1: 1.5}
#: Bands of keys, evenly by their chance.
BANDS = 4096


def n_words(text: F.Column) -> F.Column:
    """Runs of bytes other than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size) with target. Sources are taken in the order of cap * size / weight: the first ones stop at their cap, the rest share what is left by weight."""
    everything = W.partitionBy()
    named = W.orderBy(F.col("source").asc_nulls_last())
    rising = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    w = F.array(*[F.lit(x) for x in weights])
    x = sizes.withColumn("_w", F.element_at(w, F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1))
    x = x.withColumn("_most", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_most") / F.col("_w"))
    x = x.withColumn("_left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0)))
    x = x.withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # The first source that stays below its cap when it and all later ones share the rest sets the level.
    x = x.withColumn("_level", F.min(F.when(F.col("_left") / F.col("_rest") <= F.col("_ratio"), F.struct("_ratio", (F.col("_left") / F.col("_rest")).alias("v")))).over(everything)["v"])
    return x.select("source", "source_size", F.least(F.col("_most").cast("double"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_w")).alias("target"))


def row_hash() -> F.Column:
    return F.xxhash64("doc_id", "source", F.coalesce(F.col("text"), F.lit("")))


def keys(docs: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """A slim row for each of docs: doc_id, source, size, the key's chance and the key."""
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash().alias("_h"), unit_hash(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))), F.lit(seed)).alias("_u"))
    if labels is None:
        slim = slim.withColumn("_weight", F.lit(1.0))
    else:
        by_quality = F.coalesce(*[F.when(F.col("_q") == q, F.lit(v)) for q, v in QUALITY_WEIGHT.items()], F.lit(1.0))
        quality = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"))
        slim = slim.join(quality, "doc_id", "left").withColumn("_weight", by_quality).drop("_q")
    slim = slim.withColumn("_key", -F.log("_u") / F.col("_weight"))
    return slim.withColumn("_band", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.lit(BANDS)).cast("int"))


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: int = 0, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, epochs (whole), sampled (in the fractional one), taken, and _h, the row's hash."""
    slim = written(keys(docs, labels, seed), "keys")
    bands = slim.groupBy("source", "_band").agg(F.sum("size").alias("_words"))
    bands = written(bands, "bands")  # at most BANDS rows a source
    goal = targets(bands.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("_rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    running = W.partitionBy("source").orderBy("_band").rowsBetween(W.unboundedPreceding, 0)
    same = lambda a, b: a.eqNullSafe(b)
    at = bands.withColumn("_upto", F.sum("_words").over(running)).withColumnRenamed("source", "_s").join(goal, same(F.col("_s"), F.col("source")))
    # The boundary lies in the first band whose running sum passes the rest.
    edge = at.where("_upto > _rest").groupBy("source").agg(F.min(F.struct("_band", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_edge"))
    plan = goal.withColumnRenamed("source", "_s").join(edge, same(F.col("_s"), F.col("source")), "left")
    plan = written(plan.select(F.col("_s"), "source_size", "target", "epochs", "_rest", F.coalesce(F.col("_edge._band"), F.lit(BANDS + 1)).alias("_edge"), F.coalesce(F.col("_edge._before"), F.lit(0)).alias("_before")), "plan")
    rows = slim.join(plan, same(F.col("source"), F.col("_s")))
    cols = ["doc_id", "source", "size", "source_size", "target", "epochs", "_h"]
    clear = rows.where("_band != _edge").select(*cols, (F.col("_band") < F.col("_edge")).alias("sampled"))
    order = W.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    close = rows.where("_band = _edge").withColumn("_upto", F.sum("size").over(order) + F.col("_before"))
    close = close.select(*cols, (F.col("_upto") - F.col("size") / 2 < F.col("_rest")).alias("sampled"))
    out = clear.unionByName(close).withColumn("sampled", F.col("sampled") & (F.col("size") > 0))
    out = out.withColumn("epochs", F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("sampled").cast("long")))


def mix_rows(docs: DataFrame, labels: DataFrame | None = None, seed: int = 0, **how) -> DataFrame:
    """docs with each row as often as the mix takes it (0, 1, ... cap times); columns are as they were, whatever their names. Rows and decisions meet by a hash of id, source and text; rows that share all three share their decisions out."""
    times = mix(docs, labels, seed, **how).groupBy("_h").agg(F.sum(F.col("epochs") + F.col("sampled").cast("long")).alias("times"), F.count("*").alias("rows"))
    picked = docs.select(row_hash().alias("_h"), F.struct("*").alias("row")).join(times.where("times > 0"), "_h")
    # Equal rows have one key: only where a source ends among them do they part, which is once a source.
    even = picked.where("times % rows = 0").select("row", F.expr("cast(times div rows as int)").alias("copies"))
    turn = F.row_number().over(W.partitionBy("_h").orderBy(F.xxhash64(*[F.col(f"row.`{c}`") for c in hashable(docs)]))) - 1
    odd = picked.where("times % rows > 0").withColumn("copies", (F.expr("times div rows") + (turn < F.pmod("times", "rows")).cast("long")).cast("int"))
    return even.unionByName(odd.where("copies > 0").select("row", "copies")).withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
