"""Evaluation of predictions: confusion, scores, intervals, significance, latency and cost."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.quantiles import quantiles
from granary.sources.store import written

#: USD an hour by device; share of the accuracy that a costlier model must add; budget of the 95th percentile in ms; measured runs and warm-ups at least.
HOURLY_RATE = {"cpu": 0.192, "gpu": 0.60}
BAR, BUDGET_MS, LEAST_RUNS, LEAST_WARMUPS = 0.03, 50.0, 200, 20


def unpivot(wide: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """(keep..., model, pred): a row for each model."""
    return wide.selectExpr(*keep, f"stack({len(models)}, {', '.join(f'''{m!r}, {m}''' for m in models)}) AS (model, pred)")


def confusion(preds: DataFrame, label: str = "label") -> DataFrame:
    """Counts of every (model, true, predicted) over the labels that occur as either, zeros included."""
    counts = preds.groupBy("model", F.col(label).alias("truth"), "pred").agg(F.count("*").alias("n"))
    names = counts.select(F.col("truth").alias("l")).union(counts.select("pred")).distinct()
    grid = counts.select("model").distinct().crossJoin(F.broadcast(names.withColumnRenamed("l", "truth"))).crossJoin(F.broadcast(names.withColumnRenamed("l", "pred")))  # labels are few
    return grid.join(counts, ["model", "truth", "pred"], "left").na.fill(0, ["n"])


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; what has no denominator is 0."""
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    rows = cells.groupBy("model", F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    cols = cells.groupBy("model", F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    x = rows.join(cols, ["model", "cls"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return x.select("model", "cls", "support", "predicted", "tp", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def quality(classes: DataFrame) -> DataFrame:
    """Per model accuracy, macro and weighted F1 over classes that occur in truth, balanced accuracy, and the gap between the best and the worst class."""
    k = classes.where("support > 0")
    return k.groupBy("model").agg(
        F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"), F.round(F.avg("recall"), 6).alias("balanced_accuracy"), F.round(F.max("f1") - F.min("f1"), 6).alias("f1_gap"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; null where n is 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def slice_accuracy(preds: DataFrame, slices: dict[str, Column], label: str = "label") -> DataFrame:
    """Accuracy and its interval of each model in each slice, in one pass over the rows."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in slices.items()]))
    x = preds.withColumn("slice", F.explode(names)).groupBy("slice", "model").agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col("pred")).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return x.select("slice", "model", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def slice_enrichment(wide: DataFrame, a: str, b: str, slices: dict[str, Column], label: str = "label") -> DataFrame:
    """Each slice's rate among rows that b fixes (a wrong, b right) and breaks, over its rate in all rows."""
    right_a, right_b = F.col(a) == F.col(label), F.col(b) == F.col(label)
    x = wide.select(*[c.cast("int").alias(k) for k, c in slices.items()], (~right_a & right_b).alias("fixed"), (right_a & ~right_b).alias("broken"))
    one = x.agg(*[e for k in slices for e in (F.avg(k).alias(f"a_{k}"), F.avg(F.when(F.col("fixed"), F.col(k))).alias(f"f_{k}"), F.avg(F.when(F.col("broken"), F.col(k))).alias(f"b_{k}"))])
    y = one.selectExpr(f"stack({len(slices)}, {', '.join(f'''{k!r}, a_{k}, f_{k}, b_{k}''' for k in slices)}) AS (slice, base, fixed, broken)")
    over = lambda c: F.round(F.when(F.col("base") > 0, F.col(c) / F.col("base")), 6)
    return y.select("slice", F.round("base", 6).alias("base"), over("fixed").alias("fixed_lift"), over("broken").alias("broken_lift"))


def error_pairs(preds: DataFrame, unreadable: str = "UNPARSEABLE", label: str = "label") -> DataFrame:
    """Confused pairs regardless of direction; unreadable answers apart."""
    wrong = preds.where(F.col(label) != F.col("pred"))
    odd = F.col("pred") == unreadable
    pair = F.when(odd, F.array(F.col(label), F.lit(unreadable))).otherwise(F.array_sort(F.array(label, "pred")))
    return wrong.groupBy("model", pair[0].alias("a"), pair[1].alias("b")).agg(F.count("*").alias("n"))


def hard_core(wide: DataFrame, models: list[str], label: str = "label") -> DataFrame:
    """Rows that every model gets wrong."""
    return wide.where(reduce(lambda x, y: x & y, [F.col(m) != F.col(label) for m in models]))


def complementarity(wide: DataFrame, models: list[str], label: str = "label") -> DataFrame:
    """For each model the rows that it alone gets right."""
    right = {m: F.col(m) == F.col(label) for m in models}
    one = wide.agg(*[F.count_if(reduce(lambda x, y: x & y, [right[m], *[~right[o] for o in models if o != m]])).alias(m) for m in models])
    return one.selectExpr(f"stack({len(models)}, {', '.join(f'''{m!r}, {m}''' for m in models)}) AS (model, alone_right)")


def mcnemar(wide: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """Exact two-sided test of discordant pairs; null without any. Binomial terms add up in logarithms, one step each."""
    x = wide.agg(F.count_if((F.col(a) == F.col(label)) & (F.col(b) != F.col(label))).alias("only_a"), F.count_if((F.col(a) != F.col(label)) & (F.col(b) == F.col(label))).alias("only_b"))
    n, k = "(only_a + only_b)", "least(only_a, only_b)"
    tail = f"if({k} = 0, exp(-{n} * ln(2D)), aggregate(sequence(1L, greatest({k}, 1L)), named_struct('l', -{n} * ln(2D), 's', exp(-{n} * ln(2D))), (t, i) -> named_struct('l', t.l + ln(({n} - i + 1) / i), 's', t.s + exp(t.l + ln(({n} - i + 1) / i))), t -> t.s))"
    return x.withColumn("p", F.expr(f"if({n} = 0, cast(null as double), round(least(1D, 2 * {tail}), 9))"))


def bootstrap(wide: DataFrame, a: str, b: str, resamples: int, seed: int = 7, label: str = "label") -> DataFrame:
    """Paired bootstrap of the macro-F1 difference b - a: (r, delta). A resample's figures depend only on how often it draws each combination of
    (label, a, b), so these counts (a cube of the classes, however many the rows) are drawn from their multinomial distribution; rows never leave their tasks."""
    cells = wide.groupBy(label, a, b).agg(F.count("*").alias("n")).orderBy(label, a, b).collect()
    if not cells:
        return wide.sparkSession.createDataFrame([], "r long, delta double")
    n = np.array([c["n"] for c in cells], np.int64)
    classes = sorted({c[label] for c in cells}, key=str)
    hit = lambda f: np.array([[f(c, k) for k in classes] for c in cells], np.int64)
    t, pa, pb = (hit(lambda c, k, x=x: c[x] == k) for x in (label, a, b))
    rng, out = np.random.default_rng(seed), []
    for i in range(0, resamples, 1000):
        drawn = rng.multinomial(n.sum(), n / n.sum(), min(1000, resamples - i))
        true, f1 = drawn @ t, []
        for p in (pa, pb):
            f1.append(np.nansum(np.where(true > 0, 2 * (drawn @ (t * p)) / np.maximum(true + drawn @ p, 1), 0.0), 1) / (true > 0).sum(1))
        out += [(i + j, float(x)) for j, x in enumerate(f1[1] - f1[0])]
    return wide.sparkSession.createDataFrame(out, "r long, delta double")


def bootstrap_summary(deltas: DataFrame) -> DataFrame:
    p = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))  # one value a resample
    return deltas.agg(F.count("*").alias("resamples"), F.round(F.avg("delta"), 6).alias("mean"), F.round(p[0], 6).alias("lo"), F.round(p[1], 6).alias("hi"), F.round(F.avg((F.col("delta") > 0).cast("int")), 6).alias("p_better"), F.round(F.avg((F.col("delta") >= BAR).cast("int")), 6).alias("p_over_bar"))


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs, percentiles, mean, least, largest and deviation of a group's times. The times are written first, as both passes must see the same."""
    x = written(df.select(*by, value), "times")
    p = quantiles(x, {"_p": F.col(value)}, [0.5, 0.95, 0.99], by).select(*[F.col(c).alias(f"_{c}") for c in by], "_p")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))
    g = x.groupBy(*by).agg(F.count(value).alias("runs"), *[F.round(e, 6).alias(n) for n, e in (("mean", F.avg(value)), ("min", F.min(value)), ("max", F.max(value)), ("sd", F.coalesce(F.stddev_samp(value), F.lit(0.0))))])
    return g.join(p, same).select(*by, "runs", *[F.round(F.col("_p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "mean", "min", "max", "sd")


def significant(x: Column, digits: int = 4) -> Column:
    """x rounded to so many significant figures; 0 and null stay."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, 0.0).otherwise(F.round(x / unit) * unit)


def cost(df: DataFrame, rows_per_second: str, device: str) -> DataFrame:
    tier = F.when(F.col(device).startswith("cuda"), "gpu").otherwise("cpu")
    rate = F.when(tier == "gpu", HOURLY_RATE["gpu"]).otherwise(HOURLY_RATE["cpu"])
    usd = 1000.0 / F.col(rows_per_second) / 3600.0 * rate
    return df.withColumn("tier", tier).withColumn("usd_per_1000", significant(usd)).withColumn("usd_per_1m", significant(usd * 1000)).withColumn("seconds_per_1000", F.round(1000.0 / F.col(rows_per_second), 4))


def decide(models: DataFrame, baseline_family: str = "classical") -> DataFrame:
    """models(model, family, macro_f1, p95_ms, usd_per_1000): each other model against the best of the baseline family."""
    best = models.where(F.col("family") == baseline_family).orderBy(F.desc("macro_f1"), "model").limit(1).select(F.col("macro_f1").alias("bf"), F.col("p95_ms").alias("bp"), F.col("usd_per_1000").alias("bu"))
    x = models.where(F.col("family") != baseline_family).crossJoin(F.broadcast(best))
    bar, fast = F.col("macro_f1") >= F.col("bf") + BAR, F.col("p95_ms") <= BUDGET_MS
    return x.select("model", F.round(F.col("macro_f1") - F.col("bf"), 6).alias("margin"), bar.alias("passes_bar"), fast.alias("passes_budget"), (bar & fast).alias("worth_it"), F.round(F.col("p95_ms") / F.col("bp"), 4).alias("latency_x"), F.round(F.col("usd_per_1000") / F.col("bu"), 4).alias("cost_x"))


def protocol_violations(runs: DataFrame) -> DataFrame:
    """runs(model, runs, warmups, cpu, gpu, ram): models with too few runs or warm-ups, or from another machine than the first."""
    mark = F.concat_ws("|", "cpu", "gpu", "ram")
    first = runs.orderBy("model").limit(1).select(mark.alias("_first"))
    x = runs.crossJoin(F.broadcast(first)).withColumn("problem", F.explode(F.array_compact(F.array(F.when(F.col("runs") < LEAST_RUNS, "runs"), F.when(F.col("warmups") < LEAST_WARMUPS, "warmups"), F.when(mark != F.col("_first"), "hardware")))))
    return x.select("model", "problem")


def param_effects(runs: DataFrame, params: list[str], score: str) -> DataFrame:
    """Mean score for each value of each hyper-parameter, whatever the others are."""
    x = runs.selectExpr(score, f"stack({len(params)}, {', '.join(f'''{p!r}, cast({p} as string)''' for p in params)}) AS (param, value)")
    return x.groupBy("param", "value").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"))


def seed_spread(runs: DataFrame, by: str, score: str, baseline: Column) -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("seeds"), F.round(F.avg(score), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(score), F.lit(0.0)), 6).alias("sd"), F.round(F.min(score), 6).alias("min"), F.round(F.max(score), 6).alias("max"), F.count_if(F.col(score) > baseline).alias("wins"))


def average_ranks(df: DataFrame, col: str, by: list[str] | None = None) -> Column:
    """Ranks from 1, ties sharing their mean."""
    p = W.partitionBy(*(by or []))
    return F.rank().over(p.orderBy(col)) + (F.count("*").over(W.partitionBy(*(by or []), col)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    r = df.select(average_ranks(df, x).alias("rx"), average_ranks(df, y).alias("ry"))
    return r.agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def regression(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Root mean squared log error, mean absolute error, R squared."""
    t, p = F.col(truth), F.col(pred)
    e = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(t)
    return df.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmsle"), F.round(F.avg(F.abs(t - p)), 6).alias("mae"), F.round(1 - F.sum((t - p) * (t - p)) / (F.var_pop(t) * F.count("*")), 6).alias("r2"))


def parse_report(answers: DataFrame, raw: str, strict: Column, lenient: Column, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Shares of answers read strictly and leniently, and the most frequent unreadable ones (their first 60 characters)."""
    rates = answers.agg(F.count("*").alias("n"), F.round(F.avg(strict.isNotNull().cast("int")), 6).alias("strict_rate"), F.round(F.avg(lenient.isNotNull().cast("int")), 6).alias("lenient_rate"))
    odd = answers.where(lenient.isNull()).groupBy(F.substring(raw, 1, 60).alias("answer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "answer").limit(k)
    return rates, odd
