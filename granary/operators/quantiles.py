"""Exact percentiles by selection: counts of ranges of values, then of the one range that holds the rank, until it holds one value.

No task and no buffer holds a column's values. What moves is a count for each bin of each range that is still searched."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.sources.store import drop_written, written

BINS = 4096
#: So many counts, or fewer, are added up in order at once instead of in rounds.
DIRECT = 100_000
#: Ranges wider than this many times their smaller end are cut by magnitude, down to TINY.
SPAN, TINY = 1e6, 1e-300
INF = float("inf")


def _same(a: Sequence[str], side: str) -> Column:
    """Null groups are groups too."""
    out = F.lit(True)
    for c in a:
        out = out & F.col(c).eqNullSafe(F.col(f"{side}{c}"))
    return out


def _bin(bins: int) -> Column:
    """The place of v between lo and hi: by magnitude where they span several, else by value. hi has the last bin to itself, so that a range always gets smaller."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    size = lambda x: F.signum(x) * F.greatest(F.lit(0.0), F.ln(F.abs(x) + TINY) - float(np.log(TINY)))
    wide = ((hi / SPAN - lo / SPAN) > F.least(F.abs(lo), F.abs(hi))) & (F.greatest(F.abs(lo), F.abs(hi)) > TINY * 1e10)
    share = F.when(wide, (size(v) - size(lo)) / (size(hi) - size(lo))).otherwise((v - lo) / (hi - lo))
    return F.when(v == hi, bins - 1).otherwise(F.least(F.floor(share * (bins - 1)), F.lit(bins - 2))).cast("int")


def quantiles(df: DataFrame, values: dict[str, Column], shares: Sequence[float], by: Sequence[str] = (), weight: Column | None = None, bins: int = BINS, direct: int = DIRECT) -> DataFrame:
    """One row for each group of `by` (one in all without `by`): for each named value its exact percentiles as an array, interpolated between neighbours.

    `weight` says how many rows a row stands for. Null values don't count, NaN is above all numbers, and infinities are values;
    a group without values has null. Equal values are counted together before anything moves, and the table of counts is
    written: a round reads it, joins it with the ranges still searched and keeps their bins' counts. A table of at most `direct`
    counts is small enough to be added up in order, which gives the same values without rounds."""
    named, by, names, asked_shares = list(by), [f"_g{i}" for i in range(len(by))], list(values), list(dict.fromkeys(float(q) for q in shares))
    n = F.lit(1) if weight is None else weight
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), values[x].cast("double").alias("v")) for i, x in enumerate(names)])).alias("_x")
    # -0.0 counts as 0.0 here: grouping makes them equal
    counts = written(df.select(*[F.col(c).alias(g) for c, g in zip(named, by, strict=True)], n.cast("long").alias("n"), one).groupBy(*by, F.col("_x.c").alias("c"), F.col("_x.v").alias("v")).agg(F.sum("n").alias("n")), "counts")
    key, v, found = [*by, "c"], F.col("v"), []
    number = v.isNotNull() & ~F.isnan("v") & (F.abs("v") < INF)
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    stats = counts.groupBy(*key).agg(
        tally(v.isNotNull()).alias("total"), tally(v == -INF).alias("low"), tally((v == INF) & ~F.isnan("v")).alias("high"), tally(F.isnan("v")).alias("nan"),
        F.min(F.when(number, v)).alias("lo"), F.max(F.when(number, v)).alias("hi"),
    )
    place = F.col("q") * (F.col("total") - 1)
    each = F.explode(F.array(*[F.lit(q) for q in asked_shares])).alias("q")
    asked = stats.where("total > 0").select("*", each).select("*", F.floor(place).alias("r0"), F.ceil(place).alias("r1"), place.alias("place"))
    small = counts.count() <= direct
    asked = asked if small else written(asked, "asked")
    r, top = F.col("r"), F.col("total") - F.col("nan")
    outside = F.when(r < F.col("low"), -INF).when(r >= top, float("nan")).when(r >= top - F.col("high"), INF)
    ranks = asked.select(*key, "total", "low", "high", "nan", "lo", "hi", F.explode(F.array("r0", "r1")).alias("r")).distinct()
    # `below`: how many values of the group come before the range lo..hi
    state = None if small else written(ranks.select(*key, "r", F.coalesce(outside, F.col("lo")).alias("lo"), F.coalesce(outside, F.col("hi")).alias("hi"), F.col("low").alias("below")), "ranks")
    open_ = (F.col("lo") < F.col("hi")) & ~F.isnan("lo")
    made = [] if small else [asked, state]
    if small:
        w = W.partitionBy(*key).orderBy("v")  # `direct` rows at most
        sums = counts.where(v.isNotNull()).withColumn("to", F.sum("n").over(w)).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("v").alias("x"), "to", (F.col("to") - F.col("n")).alias("from"))
        found.append(ranks.join(sums, _same(key, "_") & (r >= F.col("from")) & (r < F.col("to"))).select(*key, "r", "x"))
    while not small:
        found.append(state.where(~open_).select(*key, "r", F.col("lo").alias("x")))
        todo = state.where(open_)
        if todo.isEmpty():
            break
        span = todo.select(*[F.col(c).alias(f"_{c}") for c in key], "lo", "hi", "below").distinct()
        hit = counts.join(span, _same(key, "_") & v.between(F.col("lo"), F.col("hi")) & ~F.isnan("v"))
        cells = hit.select(*key, "lo", "hi", "below", "v", "n", _bin(bins).alias("bin")).groupBy(*key, "lo", "hi", "below", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        w = W.partitionBy(*key, "lo", "hi").orderBy("bin")  # `bins` rows at most
        cells = cells.withColumn("to", F.col("below") + F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
        cells = cells.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "a", "b", "from", "to")
        state = written(todo.join(cells, _same([*key, "lo", "hi"], "_") & (r >= F.col("from")) & (r < F.col("to"))).select(*key, "r", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("from").alias("below")), "ranks")
        made.append(state)
    known = found[0]
    for x in found[1:]:
        known = known.unionByName(x)
    ends = [known.select(*[F.col(c).alias(f"_{s}{c}") for c in key], F.col("r").alias(f"_{s}r"), F.col("x").alias(f"x{s}")) for s in "01"]
    got = asked.join(ends[0], _same(key, "_0") & (F.col("r0") == F.col("_0r"))).join(ends[1], _same(key, "_1") & (F.col("r1") == F.col("_1r")))
    x0, x1 = F.col("x0"), F.col("x1")
    share = F.col("place") - F.col("r0")
    value = F.when((F.col("r0") == F.col("r1")) | (x0 == x1), x0).otherwise(x0 * (1 - share) + x1 * share)
    per = got.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("q", value.alias("x")))).alias("m"))  # as many as `shares`
    # Every group has a row: a column without values stays null.
    at = lambda i: F.first(F.when(F.col("c") == i, F.col("p")), ignorenulls=True).alias(names[i])
    arrays = per.select(*key, F.array(*[F.col("m")[F.lit(float(q))] for q in shares]).alias("p"))
    wide = stats.select(*key, F.lit(None).cast("array<double>").alias("p")).unionByName(arrays)
    wide = wide.groupBy(*by).agg(*[at(i) for i in range(len(names))])
    out = written(wide.select(*[F.col(g).alias(c) for c, g in zip(named, by, strict=True)], *names), "quantiles")
    for x in (counts, *made):
        drop_written(x)
    return out
