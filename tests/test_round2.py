"""Operators that have no SQL, and forms that must not depend on how the input lies."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from granary.functions.text import decoded
from granary.operators import evaluate, graph, outliers, quality, sequences, vocab
from granary.plans.load import QUERIES


def test_bootstrap_draws_like_rows(spark):
    r = random.Random(0)
    rows = [(t, t if r.random() < 0.8 else r.choice("xyz"), t if r.random() < 0.7 else r.choice("xyz")) for t in (r.choice("xyz") for _ in range(300))]
    got = [x["delta"] for x in evaluate.bootstrap(spark.createDataFrame(rows, "label string, a string, b string"), "a", "b", 3000).collect()]

    def f1(sample, k):
        out = []
        for c in {x[0] for x in sample}:
            tp = sum(x[0] == c == x[k] for x in sample)
            out.append(2 * tp / (sum(x[0] == c for x in sample) + sum(x[k] == c for x in sample)))
        return sum(out) / len(out)

    want = [f1(s, 2) - f1(s, 1) for s in (r.choices(rows, k=300) for _ in range(600))]
    assert abs(np.mean(got) - np.mean(want)) < 0.004 and abs(np.std(got) - np.std(want)) < 0.004
    assert len(got) == 3000
    assert evaluate.bootstrap(spark.createDataFrame([], "label string, a string, b string"), "a", "b", 10).count() == 0


def test_bytes_decode_with_replacement(spark):
    texts = ["é🙂a".encode()[:n] for n in range(8)] + [b"\xff\xfea\xc3", b"\xe2\x82", b"\xf0\x9f\x99x"]
    df = spark.createDataFrame([(i, [0, 1, *(b + 6 for b in t), 2]) for i, t in enumerate(texts)], "i int, ids array<int>")
    got = {r["i"]: r["t"] for r in df.select("i", decoded(F.col("ids")).alias("t")).collect()}
    assert got == {i: t.decode("utf-8", "replace") for i, t in enumerate(texts)}


def test_sqlite_comes_back(spark):
    assert QUERIES["scan_sqlite"](spark, "/root/testdata/sf0.001").count() == 25


def test_ranks_and_zipf_agree(spark):
    r = random.Random(1)
    freq = spark.createDataFrame([(f"t{i}", int(1 / (r.random() + 0.01)) + 1) for i in range(2000)], "token string, f long").repartition(5)
    rows = sorted(((x["f"], x["token"]) for x in freq.collect()), key=lambda x: (-x[0], x[1]))
    got = {x["token"]: (x["rank"], x["first_rank"]) for x in vocab.ranks(freq).collect()}
    first = {}
    for n, (f, _) in enumerate(rows, 1):
        first.setdefault(f, n)
    assert got == {t: (n, first[f]) for n, (f, t) in enumerate(rows, 1)}
    slope, intercept = np.polyfit(np.log(np.arange(1, 2001)), np.log([f for f, _ in rows]), 1)
    fit = vocab.zipf_fit(freq).first()
    assert abs(fit["slope"] - slope) < 1e-5 and abs(fit["intercept"] - intercept) < 1e-5


def test_first_of_each_text(spark):
    rows = [(5, "a", 1), (2, "a", 2), (3, None, 3), (4, "b", 4), (9, "b", 5)]
    got = sorted(map(tuple, quality.first_per_text(spark.createDataFrame(rows, "doc_id int, text string, x int"), "doc_id").collect()))
    assert got == [(2, "a", 2), (4, "b", 4)]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUBS", 4)
    r = random.Random(2)
    edges = [(1, i) for i in range(100, 900)] + [(5000, i) for i in range(1000, 1500)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(899, 5000), (7, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folds_deal_each_class_in_hash_order(spark):
    rows = [(i if i % 97 else None, None if i % 5 == 0 else f"c{i % 3}", i) for i in range(600)]
    got = {r["n"]: r["fold"] for r in sequences.folds(spark.createDataFrame(rows, "k long, label string, n long").repartition(7), "k", "label").collect()}
    assert len(got) == 600
    for label in {x[1] for x in rows}:
        of = [x for x in rows if x[1] == label and x[0] is not None]
        if not any(x[0] is None and x[1] == label for x in rows):
            order = sorted(of, key=lambda x: (hashlib.md5(f"7|{x[0]}".encode()).hexdigest(), x[0]))
            assert [got[x[2]] for x in order] == [i % 5 for i in range(len(order))]
        sizes = Counter(got[x[2]] for x in rows if x[1] == label)
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_rare_share_counts_tokens_in_one_and_in_two_documents(spark):
    rows = [(1, "a", "x x y z z z"), (2, "a", "y w z"), (3, "b", "z z q"), (4, "b", None), (5, None, " "), (None, "a", "q v")]
    got = {r["doc_id"]: r["rare_share"] for r in outliers.flags(spark.createDataFrame(rows, "doc_id long, label string, text string"), "^x").collect()}
    assert got == {1: 0.5, 2: round(2 / 3, 6), 3: round(1 / 3, 6), 4: 0.0, 5: 0.0, None: 0.0}
