"""Evaluation of three rule-based predictors of the documents' language, and of timings from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.text import parse_label
from granary.operators import evaluate
from granary.operators.quantiles import quantiles
from granary.plans.catalog import ASCII_LOW, ASCII_UP, corpus, query, table

#: The same expressions in both engines: markers, markers in another order, and a rule that often guesses.
M1 = "CASE WHEN contains(text, ' der ') OR contains(text, ' und ') THEN 'de' WHEN contains(text, ' las ') OR contains(text, ' el ') THEN 'es' WHEN contains(text, ' une ') OR contains(text, ' et ') THEN 'fr' ELSE 'en' END"
M2 = "CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' de ') THEN 'fr' WHEN contains(text, ' in ') THEN 'de' WHEN contains(text, ' la ') THEN 'es' ELSE 'UNPARSEABLE' END"
M3 = "CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 3 = 0 THEN 'en' ELSE 'de' END"
WIDE = f"wide AS (SELECT doc_id, text, lang AS label, {M1} AS m1, {M2} AS m2, {M3} AS m3 FROM documents)"
PREDS = WIDE + ", preds AS (SELECT doc_id, text, label, 'm1' AS model, m1 AS pred FROM wide UNION ALL SELECT doc_id, text, label, 'm2', m2 FROM wide UNION ALL SELECT doc_id, text, label, 'm3', m3 FROM wide)"
CELLS = PREDS + """, names AS (SELECT label AS l FROM preds UNION SELECT pred FROM preds), cells AS (SELECT m.model, t.l AS truth, p.l AS pred, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN names t CROSS JOIN names p LEFT JOIN (SELECT model, label, pred, count(*) AS n FROM preds GROUP BY ALL) c ON c.model = m.model AND c.label = t.l AND c.pred = p.l)"""
CLASSES = CELLS + """, s AS (SELECT model, truth AS cls, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS BIGINT) AS tp FROM cells GROUP BY ALL), q AS (SELECT model, pred AS cls, CAST(sum(n) AS BIGINT) AS predicted FROM cells GROUP BY ALL),
classes AS (SELECT model, cls, support, predicted, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM s JOIN q USING (model, cls))"""
MODELS = ["m1", "m2", "m3"]
SLICES = {"short": "length(text) < 400", "long": "length(text) > 5000", "digits": "doc_id % 7 = 0", "every": "doc_id >= 0"}


def wide(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", "text", "lang AS label", f"{M1} AS m1", f"{M2} AS m2", f"{M3} AS m3")


def preds(spark, d):
    return evaluate.unpivot(wide(spark, d), MODELS, ["doc_id", "text", "label"])


def classes(spark, d):
    return evaluate.per_class(evaluate.confusion(preds(spark, d)))


@query("confusion", f"WITH {CELLS} SELECT * FROM cells")
def _(spark, d):
    return evaluate.confusion(preds(spark, d))


@query("per_class_metrics", f"WITH {CLASSES} SELECT model, cls, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM classes")
def _(spark, d):
    return classes(spark, d).select("model", "cls", "support", "predicted", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("quality_metrics", f"WITH {CLASSES} SELECT model, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall), 6) AS balanced_accuracy, round(max(f1) - min(f1), 6) AS f1_gap FROM classes WHERE support > 0 GROUP BY model")
def _(spark, d):
    return evaluate.quality(classes(spark, d))


def _wilson(sign: str) -> str:
    z = "1.96::DOUBLE"
    return f"round(((k / n + {z} * {z} / (2 * n)) {sign} {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n), 6)"


@query("slice_accuracy", f"WITH {PREDS}, x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS slice, * FROM preds WHERE {c}" for k, c in SLICES.items()) + f"), g AS (SELECT slice, model, count(*) AS n, count(*) FILTER (label = pred) AS k FROM x GROUP BY ALL) SELECT slice, model, n, k, round(k / n, 6) AS accuracy, {_wilson('-')} AS lo, {_wilson('+')} AS hi FROM g")
def _(spark, d):
    return evaluate.slice_accuracy(preds(spark, d), {k: F.expr(c) for k, c in SLICES.items()})


@query("wilson", f"WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS k FROM documents GROUP BY lang) SELECT lang, n, k, {_wilson('-')} AS lo, {_wilson('+')} AS hi FROM g")
def _(spark, d):
    x = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("k"))
    lo, hi = evaluate.wilson(F.col("k"), F.col("n"))
    return x.select("lang", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("slice_enrichment", f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{k}' AS slice, round(avg(({c})::INTEGER), 6) AS base, round(avg(({c})::INTEGER) FILTER (m2 <> label AND m1 = label) / avg(({c})::INTEGER), 6) AS fixed_lift, round(avg(({c})::INTEGER) FILTER (m2 = label AND m1 <> label) / avg(({c})::INTEGER), 6) AS broken_lift FROM wide" for k, c in SLICES.items()))
def _(spark, d):
    return evaluate.slice_enrichment(wide(spark, d), "m2", "m1", {k: F.expr(c) for k, c in SLICES.items()})


@query("error_pairs", f"WITH {PREDS} SELECT model, CASE WHEN pred = 'UNPARSEABLE' THEN label ELSE least(label, pred) END AS a, CASE WHEN pred = 'UNPARSEABLE' THEN pred ELSE greatest(label, pred) END AS b, count(*) AS n FROM preds WHERE label <> pred GROUP BY ALL")
def _(spark, d):
    return evaluate.error_pairs(preds(spark, d))


@query("hard_core", f"WITH {WIDE} SELECT doc_id FROM wide WHERE m1 <> label AND m2 <> label AND m3 <> label")
def _(spark, d):
    return evaluate.hard_core(wide(spark, d), MODELS).select("doc_id")


@query("complementarity", f"WITH {WIDE} SELECT 'm1' AS model, count(*) FILTER (m1 = label AND m2 <> label AND m3 <> label) AS alone_right FROM wide UNION ALL SELECT 'm2', count(*) FILTER (m2 = label AND m1 <> label AND m3 <> label) FROM wide UNION ALL SELECT 'm3', count(*) FILTER (m3 = label AND m2 <> label AND m1 <> label) FROM wide")
def _(spark, d):
    return evaluate.complementarity(wide(spark, d), MODELS)


@query("positional_align", f"WITH {WIDE} SELECT count(*) AS n_rows, count(*) FILTER (m1 = m2) AS agree FROM wide")
def _(spark, d):
    a, b = wide(spark, d).select("doc_id", "m1"), wide(spark, d).select("doc_id", F.col("m2"))
    return a.join(b, "doc_id", "full").agg(F.count("*").alias("n_rows"), F.count_if(F.col("m1") == F.col("m2")).alias("agree"))


@query("mcnemar_exact", f"WITH {WIDE}, x AS (SELECT count(*) FILTER (m1 = label AND m2 <> label) AS only_a, count(*) FILTER (m1 <> label AND m2 = label) AS only_b FROM wide) SELECT only_a, only_b, CASE WHEN only_a + only_b = 0 THEN NULL ELSE round(least(1, 2 * list_sum(list_transform(range(least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))), 9) END AS p FROM x")
def _(spark, d):
    return evaluate.mcnemar(wide(spark, d), "m1", "m2")


B = 10_000


@query("paired_bootstrap")
def _(spark, d):
    return evaluate.bootstrap_summary(evaluate.bootstrap(wide(spark, d).where("doc_id % 10 = 9"), "m2", "m1", B))


@query("split_label_words", f"""WITH {PREDS}, p AS (SELECT unnest(['der', 'the', 'las', 'une']) AS probe) SELECT probe, model, count(*) FILTER (doc_id % 10 < 8) AS n_train, round(avg((label = 'en')::INTEGER) FILTER (doc_id % 10 < 8), 6) AS train_en_share, round(avg((label = pred)::INTEGER) FILTER (doc_id % 10 >= 8), 6) AS held_accuracy FROM p JOIN preds ON contains(text, ' ' || probe || ' ') GROUP BY ALL""")
def _(spark, d):
    probes = spark.createDataFrame([(x,) for x in ("der", "the", "las", "une")], "probe string")
    x = preds(spark, d).join(F.broadcast(probes), F.col("text").contains(F.concat(F.lit(" "), "probe", F.lit(" "))))
    train = F.pmod("doc_id", F.lit(10)) < 8
    return x.groupBy("probe", "model").agg(F.count_if(train).alias("n_train"), F.round(F.avg(F.when(train, (F.col("label") == "en").cast("int"))), 6).alias("train_en_share"), F.round(F.avg(F.when(~train, (F.col("label") == F.col("pred")).cast("int"))), 6).alias("held_accuracy"))


TIMES = "times AS (SELECT event_type AS model, value AS ms FROM events WHERE value IS NOT NULL)"


@query("latency_percentiles", f"WITH {TIMES} SELECT model, count(ms) AS runs, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(avg(ms), 6) AS mean, round(min(ms), 6) AS min, round(max(ms), 6) AS max, round(coalesce(stddev_samp(ms), 0), 6) AS sd FROM times GROUP BY model")
def _(spark, d):
    return evaluate.latency(table(spark, d, "events").where("value is not null").withColumnRenamed("event_type", "model"), ["model"], "value")


RATES = "rates AS (SELECT event_type AS model, CASE WHEN event_type < 'm' THEN 'cpu' ELSE 'cuda:0' END AS device, 1000.0::DOUBLE / avg(value) AS rps FROM events GROUP BY event_type), usd AS (SELECT *, CASE WHEN device LIKE 'cuda%' THEN 'gpu' ELSE 'cpu' END AS tier, 1000.0::DOUBLE / rps / 3600.0::DOUBLE * CASE WHEN device LIKE 'cuda%' THEN 0.6::DOUBLE ELSE 0.192::DOUBLE END AS u FROM rates)"


def _sig(x: str) -> str:
    return f"round(round({x} / pow(10, floor(log10(abs({x}))) - 3)) * pow(10, floor(log10(abs({x}))) - 3), 12)"


def rates(spark, d):
    x = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg((1000.0 / F.avg("value")).alias("rps"))
    return evaluate.cost(x.withColumn("device", F.when(F.col("model") < "m", "cpu").otherwise("cuda:0")), "rps", "device")


@query("cost_model", f"WITH {RATES} SELECT model, tier, {_sig('u')} AS usd_per_1000, {_sig('(u * 1000)')} AS usd_per_1m, round(1000.0::DOUBLE / rps, 4) AS seconds_per_1000 FROM usd")
def _(spark, d):
    return rates(spark, d).select("model", "tier", F.round("usd_per_1000", 12).alias("usd_per_1000"), F.round("usd_per_1m", 12).alias("usd_per_1m"), "seconds_per_1000")


@query("decision_rule", f"""WITH m AS (SELECT event_type AS model, CASE WHEN event_type < 'm' THEN 'classical' ELSE 'tuned' END AS family, avg(value) / 100 AS macro_f1, quantile_cont(value, 0.95) AS p95, avg(value) AS usd FROM events GROUP BY event_type), b AS (SELECT * FROM m WHERE family = 'classical' ORDER BY macro_f1 DESC, model LIMIT 1)
SELECT m.model, round(m.macro_f1 - b.macro_f1, 6) AS margin, m.macro_f1 >= b.macro_f1 + 0.03::DOUBLE AS passes_bar, m.p95 <= 50 AS passes_budget, m.macro_f1 >= b.macro_f1 + 0.03::DOUBLE AND m.p95 <= 50 AS worth_it, round(m.p95 / b.p95, 4) AS latency_x, round(m.usd / b.usd, 4) AS cost_x FROM m, b WHERE m.family <> 'classical'""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), "value")
    p95 = quantiles(e, {"p": F.col("value")}, [0.95], ["model"]).select(F.col("model").alias("_model"), F.col("p")[0].alias("p95_ms"))
    x = e.groupBy("model").agg((F.avg("value") / 100).alias("macro_f1"), F.avg("value").alias("usd_per_1000")).join(p95, F.col("model").eqNullSafe(F.col("_model"))).drop("_model")
    return evaluate.decide(x.withColumn("family", F.when(F.col("model") < "m", "classical").otherwise("tuned")))


AUDIT = "SELECT event_type || '_' || user_id AS model, count(*) AS runs, count(*) FILTER (value > 20) AS warmups, 'cpu' || (user_id % 9 = 0)::INTEGER AS cpu, 'gpu' AS gpu, '16' AS ram FROM events GROUP BY event_type, user_id"


def timed_runs(events):
    x = events.groupBy("event_type", "user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 20).alias("warmups"))
    return x.select(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("model"), "runs", "warmups", F.concat(F.lit("cpu"), (F.col("user_id") % 9 == 0).cast("int").cast("string")).alias("cpu"), F.lit("gpu").alias("gpu"), F.lit("16").alias("ram"))


@query("protocol_audit", f"WITH r AS ({AUDIT}), f AS (SELECT cpu || '|' || gpu || '|' || ram AS m FROM r ORDER BY model LIMIT 1) SELECT model, 'runs' AS problem FROM r WHERE runs < 200 UNION ALL SELECT model, 'warmups' FROM r WHERE warmups < 20 UNION ALL SELECT model, 'hardware' FROM r, f WHERE cpu || '|' || gpu || '|' || ram <> m")
def _(spark, d):
    return evaluate.protocol_violations(timed_runs(table(spark, d, "events")))


@query("rep_effects", "SELECT param, value, count(*) AS n, round(avg(v), 6) AS mean_score FROM (SELECT 'event_type' AS param, event_type AS value, value AS v FROM events UNION ALL SELECT 'third', CAST(user_id % 3 AS VARCHAR), value FROM events) GROUP BY ALL")
def _(spark, d):
    return evaluate.param_effects(table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("third"), F.col("value").alias("v")), ["event_type", "third"], "v")


@query("seed_spread", "SELECT event_type, count(*) AS seeds, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) FILTER (v > 50) AS wins FROM (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def _(spark, d):
    x = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return evaluate.seed_spread(x, "event_type", "v", F.lit(50.0))


RANKS = "r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS rx, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS ry FROM customer)"


@query("spearman", f"WITH {RANKS} SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r")
def _(spark, d):
    return evaluate.spearman(table(spark, d, "customer"), "c_acctbal", "c_nationkey")


@query("regression_metrics", "SELECT count(*) AS n, round(sqrt(avg(pow(ln(1 + p) - ln(1 + t), 2))), 6) AS rmsle, round(avg(abs(t - p)), 6) AS mae, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice AS t, l_quantity * 1500.0::DOUBLE AS p FROM lineitem)")
def _(spark, d):
    return evaluate.regression(table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p")


ANSWERS = f"answers AS (SELECT turn, text AS raw, translate(text, '{ASCII_UP}', '{ASCII_LOW}') AS low FROM conversations), read AS (SELECT raw, CASE WHEN regexp_replace(low, '^[^a-z]+|[^a-z]+$', '', 'g') IN ('the', 'of', 'der', 'user') THEN 1 ELSE 0 END AS s, CASE WHEN regexp_matches(low, '\\b(the|of|der|user)\\b') THEN 1 ELSE 0 END AS l FROM answers)"
WORDS = ["the", "of", "der", "user"]


@query("parse_report", f"WITH {ANSWERS} SELECT count(*) AS n, round(avg(s), 6) AS strict_rate, round(avg(l), 6) AS lenient_rate FROM read")
def _(spark, d):
    return evaluate.parse_report(table(spark, d, "conversations"), "text", *parse_label(F.col("text"), WORDS))[0]


@query("parse_unreadable", f"WITH {ANSWERS} SELECT left(raw, 60) AS answer, count(*) AS n FROM read WHERE l = 0 GROUP BY 1 ORDER BY n DESC, answer LIMIT 15")
def _(spark, d):
    return evaluate.parse_report(table(spark, d, "conversations"), "text", *parse_label(F.col("text"), WORDS))[1]


@query("select_best_smallest", "WITH k AS (SELECT user_id AS k, round(avg(value), 1) AS score FROM events GROUP BY user_id) SELECT k, score FROM k ORDER BY score DESC, k LIMIT 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.round(F.avg("value"), 1).alias("score")).orderBy(F.desc("score"), "k").limit(1)


@query("model_leaderboard", "SELECT event_type, round(avg(value), 6) AS score FROM events GROUP BY event_type ORDER BY score DESC, event_type LIMIT 3")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("score")).orderBy(F.desc("score"), "event_type").limit(3)


@query("dummy_baseline", "WITH m AS (SELECT lang FROM documents WHERE doc_id % 10 < 8 GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) SELECT d.doc_id, m.lang AS pred FROM documents d, m WHERE doc_id % 10 = 9")
def _(spark, d):
    df = corpus(spark, d)
    top = df.where("split = 'train'").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("pred"))
    return df.where("split = 'test'").select("doc_id").crossJoin(F.broadcast(top))
