"""Small fixtures worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from granary.functions.text import byte_ids, parse_label
from granary.operators import cluster, evaluate, features, graph, mining, models, outliers, profile, quality, sequences, similarity, tasks, vocab
from granary.sources import readers, writers


def one(df):
    return df.first().asDict()


def test_lines_split_at_the_last_semicolon(spark):
    x = readers.split_lines(spark.createDataFrame([("a;b;joy",), ("  ",), ("no label",), (";x",)], "value string")).collect()
    assert [(r["text"], r["label"], r["malformed"]) for r in x] == [("a;b", "joy", None), (None, None, "no label"), ("", "x", None)]


def test_sniffed_separator(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b;c\n1;2;3\n")
    assert readers.read_sniffed(spark, str(tmp_path / "x.csv")).columns == ["a", "b", "c"]


def test_frozen_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    writers.freeze(df, str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").glob("split=*")) == ["split=test", "split=train"]


def test_many_to_one_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="key repeats"):
        readers.many_to_one(a, b, "k").collect()


def test_contract(spark):
    with pytest.raises(ValueError, match="known by 1 rows"):
        profile.assert_contract(spark.createDataFrame([(1,), (None,)], "x int"), {"known": F.col("x").isNotNull()})


def test_ties_have_a_total_order(spark):
    df = spark.createDataFrame([(1, "b a c", "x")], "doc_id long, text string, label string")
    assert [r["token"] for r in vocab.ranks(vocab.frequencies(df)).orderBy("rank").collect()] == ["a", "b", "c"]


def test_divergence_bounds(spark):
    c = spark.createDataFrame([("x", "a", 3), ("y", "b", 5), ("z", "a", 3)], "label string, token string, n long")
    js = {(r["a"], r["b"]): r["js"] for r in vocab.js_divergence(c).collect()}
    assert js == {("x", "y"): 1.0, ("x", "z"): 0.0, ("y", "z"): 1.0}


def test_empty_class_scores_zero(spark):
    p = spark.createDataFrame([("m", "a", "a"), ("m", "b", "a")], "model string, label string, pred string")
    k = {r["cls"]: r for r in evaluate.per_class(evaluate.confusion(p)).collect()}
    assert (k["b"]["predicted"], k["b"]["precision"], k["b"]["f1"]) == (0, 0.0, 0.0)


def test_single_value_has_no_deviation(spark):
    assert one(evaluate.latency(spark.createDataFrame([("m", 3.0)], "m string, v double"), ["m"], "v"))["sd"] == 0.0


def test_null_texts_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, None, "a", "t"), (2, None, "b", "t"), (3, "x", "a", "t")], "doc_id long, text string, label string, split string")
    r = one(quality.duplicates_within(df))
    assert (r["n_rows"], r["distinct_texts"], r["repeated_texts"]) == (3, 1, 0)


def test_leakage_goes_before_conflicts(spark):
    df = spark.createDataFrame([(1, "x", "a", "train"), (2, "x", "b", "train"), (3, "x", "a", "test"), (4, "y", "a", "train"), (5, "y", "a", "train")], "doc_id long, text string, label string, split string")
    kept, counts = quality.clean(df)
    assert [r["doc_id"] for r in kept.collect()] == [4]
    assert one(counts) == {"before": 4, "leakage": 2, "conflicting": 0, "redundant": 1, "after": 1}


def test_rules(spark):
    rows = [(i, x) for i, items in enumerate(["abc", "abc", "ab", "c", "a"]) for x in items]
    sets = mining.frequent_itemsets(spark.createDataFrame(rows, "tid long, item string"), 0.4)
    rules = mining.rules(sets).collect()
    assert sum(len(r["antecedent"]) + len(r["consequent"]) == 3 for r in rules) == 6
    sure = next(r for r in rules if r["antecedent"] == ["b"] and r["consequent"] == ["a"])
    assert sure["confidence"] == 1.0 and math.isclose(sure["conviction"], (1 - 0.8) / 1e-6)
    support = {tuple(r["items"]): r["n"] for r in sets.collect()}
    assert all(support[tuple(s)] >= n for k, n in support.items() if len(k) == 2 for s in ([k[0]], [k[1]]))


def test_cluster_scores(spark):
    x = spark.createDataFrame([(-1, "a", 0.0), (0, "a", 1.0), (0, "b", 2.0)], "cluster int, label string, v double")
    r = one(cluster.purity(x))
    assert (r["size"], r["majority"], r["purity"], r["mapped_share"]) == (2, "a", 0.5, round(1 / 3, 6))
    assert one(cluster.internal_scores(x, ["v"]))["davies_bouldin"] == 99.0 and cluster.silhouette(x.where("cluster = 0"), ["v"]) == -1.0
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "cluster int, label int")
    assert one(cluster.external_scores(same)) == {"ari": 1.0, "nmi": 1.0, "homogeneity": 1.0, "completeness": 1.0}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(e).collect()} == {2: 1, 3: 1, 7: 1, 5: 4}


def test_update_tells_absent_from_null(spark):
    t = spark.createDataFrame([(i, "t", "", "low", "2024-01-01", ["x"], True, i, "0", "0", "done") for i in (1, 2, 3)], "id long, title string, notes string, priority string, due_date string, tags array<string>, completed boolean, position long, created_at string, updated_at string, completed_at string")
    p = spark.createDataFrame([(1, None, None, None, None, None, False, None), (2, None, None, None, None, None, True, None), (3, None, None, None, None, False, False, None)], "id long, title string, notes string, priority string, tags array<string>, completed boolean, has_due_date boolean, due_date string")
    r = {x["id"]: x for x in tasks.update(t, p, "now").collect()}
    assert r[1]["due_date"] == "2024-01-01" and r[2]["due_date"] is None and r[1]["completed_at"] == "done" and r[3]["completed_at"] is None
    assert {x["completed_at"] for x in tasks.bulk_complete(t, t, True, "now").collect()} == {"now"}
    assert [x["id"] for x in tasks.reorder(t, [3, 1]).orderBy("position", "id").collect()] == [3, 1, 2]


def test_bad_json_has_no_tags(spark):
    x = spark.createDataFrame([("not json",), (None,), ('["a"]',)], "j string").select(tasks.tags_from_json(F.col("j")).alias("t")).collect()
    assert [r["t"] for r in x] == [[], [], ["a"]]


def test_rush_hours_end_on_the_hour(spark):
    x = spark.createDataFrame([(-73.9, 40.7, -73.8, 40.8, f"2024-01-01 {h}", 1, 1) for h in ("10:00:00", "10:01:00", "19:00:00", "19:01:00")], "lon1 double, lat1 double, lon2 double, lat2 double, started string, riders int, vendor int").withColumn("started", F.to_timestamp("started"))
    assert [r["is_rush_hour"] for r in features.trip_features(x).collect()] == [1, 0, 1, 0]


def test_no_discordant_pairs(spark):
    w = spark.createDataFrame([("a", "a", "a")], "label string, m string, n string")
    assert one(evaluate.mcnemar(w, "m", "n"))["p"] is None
    w = spark.createDataFrame([("a", "a", "b")] * 5, "label string, m string, n string")
    assert one(evaluate.mcnemar(w, "m", "n"))["p"] == 2 / 32


def test_a_vector_is_its_own_first_neighbour(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "vec_id long, embedding array<double>")
    r = similarity.knn(v, 1, include_self=True).collect()
    assert all(x["query"] == x["neighbour"] and x["cosine"] == 1.0 for x in r) and len(r) == 4


def test_labels_read_from_answers(spark):
    x = spark.createDataFrame([("Joy.",), ("I think joy, not fear",), ("joyful",)], "a string")
    strict, lenient = parse_label(F.col("a"), ["joy", "fear"])
    assert [tuple(r) for r in x.select(strict, lenient).collect()] == [("joy", "joy"), (None, "joy"), (None, None)]


def test_bytes_and_chat(spark):
    assert spark.createDataFrame([("aé",), ("",)], "t string").select(byte_ids(F.col("t")).alias("b")).collect()[0]["b"] == [103, 201, 175]
    r = one(sequences.chat_examples(spark.createDataFrame([("s", "u", "a")], "system string, user string, assistant string"), 12))
    assert r["input_ids"] == [1, 3, 121, 16, 4, 123, 16, 5, 103, 0, 0, 0] and r["labels"] == [-100] * 7 + [103, 2, -100, -100, -100] and r["prompt_len"] == 8


def test_ridge_equals_normal_equations(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3)) * [1, 5, 0.1] + [100, 0, 7]
    y = x @ [1.0, -2.0, 3.0] + r.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = models.ridge_fit(df, ["a", "b", "c"], F.col("y"))
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(m["coefficients"], np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ (y - y.mean())))


def test_flags_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, label string")
    assert outliers.flags(empty, "x").count() == 0
