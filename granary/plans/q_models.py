"""Classifiers of the documents' language, ridge regression of trips, and the last small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.operators import batches, boosting, evaluate, features, linear, models, sequences
from granary.plans.catalog import CORPUS, corpus, query, table
from granary.plans.q_features import FEATS, good_trips
from granary.sources.store import new_path

#: Where the public vocabulary lies; it isn't part of the library.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def train_test(spark, d):
    df = corpus(spark, d)
    return df.where("split = 'train'"), df.where("split = 'test'")


@query("logreg")
def _(spark, d):
    a, b = train_test(spark, d)
    return models.fit_predict(a, b, models.logistic(1.0, a.count()))


@query("linear_svm")
def _(spark, d):
    return linear.fit_predict(*train_test(spark, d), loss="hinge", c=0.5, min_df=2)


@query("boosting")
def _(spark, d):
    return boosting.fit_predict(*train_test(spark, d))


def development(spark, d):
    return sequences.folds(corpus(spark, d).where("split <> 'test'"), "doc_id", "label", k=5)


@query("grid_cv")
def _(spark, d):
    return linear.grid_search(development(spark, d), "linear_svm", "hinge", new_path(spark, "grid"), [0.1, 0.5, 1.0])[0]


@query("grid_refit")
def _(spark, d):
    """The best of the grid, fitted on all of its rows, on the test rows."""
    df = sequences.folds(corpus(spark, d), "doc_id", "label", k=5).withColumn("fold", F.when(F.col("split") == "test", -1).otherwise(F.col("fold")))
    known = df.where("fold >= 0")
    results, _ = linear.grid_search(known, "logreg", "softmax", new_path(spark, "grid"), [1.0, 5.0, 10.0])
    return linear.refit_predict(known, df.where("fold < 0"), results, "softmax")


@query("stratified_baseline", f"WITH {CORPUS}, c AS (SELECT label, count(*) AS n FROM corpus WHERE split = 'train' GROUP BY label), s AS (SELECT label, sum(n) OVER (ORDER BY label) / sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY label) - n) / sum(n) OVER () AS lo FROM c), u AS (SELECT doc_id, CAST(('0x' || substr(md5('7|' || doc_id), 1, 12)) AS BIGINT) / {float(1 << 48)}::DOUBLE AS u FROM corpus WHERE split = 'test') SELECT doc_id, label AS pred FROM u JOIN s ON u >= lo AND u < hi")
def _(spark, d):
    a, b = train_test(spark, d)
    return models.stratified_guess(b, a, "doc_id")


@query("ridge")
def _(spark, d):
    x = features.trip_features(good_trips(spark, d))
    part = F.pmod("event_id", F.lit(5)) == 4
    m = models.ridge_fit(x.where(~part), features.FEATURES, F.log1p("seconds"))
    scored = x.where(part).withColumn("p", F.greatest(F.lit(1.0), F.expm1(models.ridge_score(m))))
    return evaluate.regression(scored, "seconds", "p")


FIXED = {"features": ["distance_km", "riders", "is_rush_hour"], "means": [10.0, 3.0, 0.3], "scales": [5.0, 1.5, 0.5], "coefficients": [0.4, 0.01, 0.2], "intercept": 6.5}


@query("ridge_score", f"WITH {FEATS} SELECT event_id, round(6.5::DOUBLE + (distance_km - 10.0::DOUBLE) / 5.0::DOUBLE * 0.4::DOUBLE + (riders - 3.0::DOUBLE) / 1.5::DOUBLE * 0.01::DOUBLE + (is_rush_hour - 0.3::DOUBLE) / 0.5::DOUBLE * 0.2::DOUBLE, 6) AS score FROM feats")
def _(spark, d):
    return features.trip_features(good_trips(spark, d)).select("event_id", F.round(models.ridge_score(FIXED), 6).alias("score"))


@query("latency_harness")
def _(spark, d):
    n = table(spark, d, "nation")
    return evaluate.latency(models.time_actions(spark, lambda: n.limit(1).collect(), 20, 200).withColumn("model", F.lit("lookup")), ["model"], "ms")


@query("subword_stats", "SELECT round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most FROM (SELECT strlen(text) AS n FROM documents)")
def _(spark, d):
    n = table(spark, d, "documents").select(F.octet_length("text").cast("long").alias("n"))  # a byte is a token
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.95)))
    return n.agg(F.round(p[0], 6).alias("p50"), F.round(p[1], 6).alias("p95"), F.max("n").alias("most"))


@query("nlargest", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars")


@query("head_limit", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE label = 'fr' ORDER BY doc_id LIMIT 5")
def _(spark, d):
    return corpus(spark, d).where("label = 'fr'").orderBy("doc_id").limit(5).select("doc_id")


WORDS = r"list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query("except", f"SELECT item_id, len(list_filter({WORDS}, lambda x: x NOT IN ('the', 'of', 'der'))) AS n_rest FROM benchmark")
def _(spark, d):
    w = F.array_distinct(tokens(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", F.size(F.array_except(w, F.array(*[F.lit(x) for x in ("the", "of", "der")]))).cast("long").alias("n_rest"))


@query("subset", f"SELECT doc_id FROM documents WHERE list_has_all({WORDS}, ['the', 'of'])")
def _(spark, d):
    w = tokens(F.col("text"))
    return table(spark, d, "documents").where(F.size(F.array_except(F.array(F.lit("the"), F.lit("of")), w)) == 0).select("doc_id")


@query("first_best_rule", "WITH b AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type, n FROM b QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def _(spark, d):
    x = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return x.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("m"), "p_type", "n")).alias("b")).select("p_brand", "b.p_type", "b.n")


@query("joblib_model")
def _(spark, d):
    """A fitted model, saved and loaded again, predicts."""
    from pyspark.ml import PipelineModel

    a, b = train_test(spark, d)
    path = new_path(spark, "model")
    models.text_pipeline(models.logistic(1.0, a.count(), iterations=5)).fit(models.with_tokens(a)).write().overwrite().save(path)
    return PipelineModel.load(path).transform(models.with_tokens(b)).select("doc_id", "_p").withColumnRenamed("_p", "pred")


@query("batch_harness")
def _(spark, d):
    """Two fitted classifiers of the labelled vectors, timed in the workers over all vectors at several batch sizes."""
    v = table(spark, d, "embeddings")
    _, mean, var = batches.class_moments(v, "label", "embedding")
    return batches.batch_summary(batches.batch_times(v, "embedding", {"nearest_mean": batches.nearest_mean(mean), "gaussian_bayes": batches.gaussian_bayes(mean, var)}, [1, 8, 32, 128, 512]))


@query("subword_report")
def _(spark, d):
    """Lengths of all texts in tokens of a public byte-level vocabulary, by language, and the shares beyond usual windows."""
    with open(VOCABULARY, "rb") as f:
        ranks = f.read()  # under 1 MB
    return batches.length_report(batches.subword_lengths(corpus(spark, d).select("label", "text"), ranks), "label", [128, 256, 512])
