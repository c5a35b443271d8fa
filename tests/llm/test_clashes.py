"""Columns with clashing names, shuffled inputs, forced paths, and rows that round 1 got wrong."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute, corpus

from granary.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, sharding, topk, toxicity

CLASH = ["_h", "_t", "_c", "_n", "_row", "_gone", "_at", "_rank", "_place", "key", "row", "number", "times", "rows", "copies", "turn", "maybe", "at", "which", "bits", "id", "crc", "size", "rest", "place"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"text of number {i % 7} with some words in it", "ab"[i % 2], *range(i, i + len(CLASH))) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in CLASH))


def kept(out, docs, like=lambda r: True):
    """Every row of out is a row of docs, value for value."""
    assert out.columns[: len(docs.columns)] == docs.columns
    known = {tuple(r) for r in docs.collect()}
    rows = out.collect()
    assert all(tuple(r)[: len(docs.columns)] in known for r in rows)
    return rows


def test_rows_keep_clashing_columns(spark, clashing):
    items = spark.createDataFrame([(1, "text of number 3 with some")], "item_id long, text string")
    assert len(kept(decontaminate.clean_rows(clashing, items), clashing)) == 17
    assert len(kept(ngram_join.one_of_each(clashing), clashing)) == 7
    taken = Counter(r["doc_id"] for r in kept(mixing.mix_rows(clashing), clashing))
    assert taken == Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(clashing).collect() if r["taken"]})
    assert len(kept(sharding.shard_rows(clashing, 3), clashing)) == 20
    assert len(kept(line_dedup.dedup(clashing), clashing)) == 20
    assert len(kept(toxicity.clean_rows(clashing, toxicity.Model(toxicity.Automaton([], []), 0.0, -1.0)), clashing)) == 20


def test_result_columns_win(clashing):
    named = clashing.select("doc_id", "text", F.lit("mine").alias("N_lines"), F.lit("mine").alias("shard"))
    assert line_dedup.dedup(named).columns == ["doc_id", "text", "shard", "n_lines", "n_removed", "removed"]
    assert sharding.shard_rows(named, 2).columns == ["doc_id", "text", "N_lines", "shard", "slot"]


def brute_lines(rows):
    """(doc_id, text) rows in order: the texts as line dedup leaves them."""
    seen, out = set(), []
    for i, text in rows:
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a in range(len(full) - 2):
            w = tuple(lines[k] for k in full[a : a + 3])
            if w in seen:
                gone |= set(full[a : a + 3])
            seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone).strip("\n") if gone else text))
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_line_dedup_of_a_shuffled_input(spark, parts):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["", " ", *"abcde"]) for _ in range(r.randint(0, 12)))) for i in range(800)]
    wide = spark.createDataFrame([(i, t, "x" * 2000) for i, t in rows], "doc_id long, text string, extra string")
    shuffled = wide.repartition(parts).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("extra").alias("extra"))
    got = line_dedup.dedup(shuffled).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)


@pytest.mark.parametrize("hot", [1, 5, 25])
def test_line_dedup_of_hot_windows(spark, monkeypatch, hot):
    """Windows beyond HOT are dealt over salts; those at and below it aren't; both lose the same lines."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SALTS", 7)
    rows = [(i, "\n".join(["one", "two", "three", "four"] + (["p", "q", "r"] if i % 6 == 0 else []) + [f"own {i}", f"line {i}"])) for i in range(30)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(str(i) for i in range(200_000))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame([(1, text), (2, "x\n" + text + "\ny")], "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "x\ny"}


def test_null_ids_link(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (None, " ".join(["x"] * 3 + words[3:])), (2, " ".join(["x"] * 3 + words[3:57] + ["y"] * 3)), (None, "z " * 9), (None, "z " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.join(docs).where("n_shingles > 5").collect()} == {1}
    left = ngram_join.one_of_each(docs).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1]


def test_null_bridges_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 4)
    rows = corpus(5)
    want = brute(rows)
    r = random.Random(0)
    hidden = {i for i, _ in rows if r.random() < 0.3}
    docs = spark.createDataFrame([(None if i in hidden else i, t, i) for i, t in rows], "doc_id long, text string, i long")
    least = {}
    for i, (_, c) in want.items():
        if i not in hidden:
            least[c] = min(i, least.get(c, i))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join(docs).collect() if x["doc_id"] is not None}
    assert got == {i: least[want[i][1]] for i in want if i not in hidden}


def test_heavy_sets_equal_brute_force(spark, monkeypatch):
    """Many sets of common passages and large groups of near copies, with every path for hot places forced."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    passages, rows = [[word() for _ in range(30)] for _ in range(4)], []
    for _ in range(60):
        rows.append((len(rows), " ".join(sum((p for p in passages if r.random() < 0.5), []) + [word() for _ in range(r.randint(0, 12))])))
    base = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(120)] = word()
        rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for hot, block in ((4, 16_000), (8, 7)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(docs).collect()} == want


def test_fine_points_bound_and_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 4000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n, dtype=np.uint64)]))
        x, y = ngram_join.Fine(a), ngram_join.Fine.unpacked(ngram_join.Fine(b).packed())
        assert (y.coarse() == ngram_join.point(b)).all() and (y.groups == ngram_join.Fine(b).groups).all()
        assert ngram_join.overlap(a, b) <= x.bound(y) <= min(len(a), len(b))


def test_decontamination_shuffles_alike(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 40])) for i in range(200)] + [(None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[30:45])), (2, "w100 w101"), (None, "w200"), (4, " ".join(words[90:110]))], "item_id long, text string")
    run = lambda d: sorted((str(r) for r in decontaminate.decontaminate(d, items).collect()))
    want = run(docs)
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    assert run(docs) == want
    assert run(docs.repartition(7).groupBy("doc_id").agg(F.first("text").alias("text"))) == want


def test_a_language_of_long_texts_is_learned(spark):
    r = np.random.default_rng(0)
    say = lambda parts, n: " ".join("".join(r.choice(parts, 3)) for _ in range(n))
    kinds = {"aa": ["tho", "ing", "wha", "ed"], "bb": ["sch", "ung", "kei", "ein"]}
    rows = [(i, say(kinds["aa"], 12_000), "aa") for i in range(4)] + [(10 + i, say(kinds["bb"], 40), "bb") for i in range(60)] + [(100 + i, "same text here", "bb") for i in range(500)]
    known = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(known["aa"]) > 100_000 and known["bb"].count(b"same text here") == 1
    asked = spark.createDataFrame([(i, say(kinds[k], 40), k) for i in range(40) for k in kinds], "doc_id long, text string, lang string")
    got = language_id.identify(asked.withColumnRenamed("doc_id", "n").withColumn("doc_id", F.monotonically_increasing_id()), known).join(asked.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in got) >= 0.95 * len(got)


def test_language_equals_brute_force(spark):
    """The operator's rows are what zstandard gives text by text."""
    import zstandard

    known = {"aa": b"the thing is that they went there " * 20, "bb": b"der schneider ging mit seinem hund " * 20}
    texts = ["They went to that thing", "Der Hund ging mit", None, "123", "the der"]
    want = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            want.append("und")
            continue
        sizes = {}
        for k, d in known.items():
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z.precompute_compress(level=language_id.LEVEL)
            sizes[k] = len(zstandard.ZstdCompressor(dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False).compress(language_id.plain(t)))
        want.append(min(sizes, key=lambda k: (sizes[k], k)))
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == want


def test_large_scores_are_exact(spark):
    r = np.random.default_rng(0)
    m = r.integers(-(2**28), 2**28, (60, 8)).astype(float)
    got = topk.top_k(spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=6, scale=1.0).collect()
    ints = [[int(x) for x in v] for v in m]
    dot = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=True))
    want = {(q, k + 1, i, dot(q, i)) for q in (0, 20, 40) for k, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-dot(q, i), i))[:6])}
    assert set(map(tuple, got)) == want
    with pytest.raises(Exception, match="too large for a long"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def say(r, n, letters="abcdefghij", k=6):
    return ["".join(r.choice(list(letters), k)) for _ in range(n)]


def test_misspellings_and_quotations_change_predictions(spark):
    """Without the edits, or without the context windows, the planted documents are judged otherwise."""
    model = toxicity.Model(toxicity.Automaton(["knavish", "zounds"], ["scoundr"]), 4.0, -2.0)
    rows = [(1, "some knav1sh here"), (2, "one kn*vish there"), (3, "a zuonds zoundz b"), (4, "sc0undrelly done"), (5, 'they said "zounds" once'), (6, "plain zounds"), (7, "2 zounds3"), (8, "clean words only"), (9, "scounded alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1, 7: 1, 8: 0, 9: 0}
    exact = lambda t: any(w.strip("0123456789*@$") in ("knavish", "zounds") or w.startswith("scoundr") for w in t.split())
    assert [i for i, t in rows if exact(t)] == [6, 7]


def test_scores_equal_brute_force(spark):
    """The score of a text is the logistic curve of the weighted hits, worked out by edit distances."""
    from test_operators import distance

    terms, r = ["knavish", "zounds", "oaf"], random.Random(3)
    model = toxicity.Model(toxicity.Automaton(terms, []), 1.5, -2.0)
    pool = [*terms, "knavsh", "zoundss", "zxunds", "oa", "oaff", "word", "other", "knave"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(80)]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        x = sum(1.0 if w in terms else toxicity.FUZZY if any(len(v) >= toxicity.MIN_FUZZY and distance(w, v) <= 1 for v in terms) else 0.0 for w in t.split())
        assert abs(got[i] - 1 / (1 + np.exp(-(1.5 * np.log1p(x) - 2.0)))) < 1e-9


def test_the_sample_bounds_rows(spark):
    docs = spark.createDataFrame([(1, f"row {i}") for i in range(50)] + [(2, "clean")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample=10)
    assert 0 < 1 / (1 + np.exp(-model.intercept)) < 1


def test_every_row_has_its_place(spark):
    """The whole table against `place` over the sorted rows."""
    import zlib

    r = random.Random(1)
    rows = [(r.randrange(50), "é" * r.randrange(5)) for _ in range(333)]
    got = Counter(map(tuple, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 7, seed=2).select("doc_id", "size", "text_crc32", "shard", "slot").collect()))
    ordered = sorted((i, zlib.crc32(t.encode()), len(t.encode()) + 16) for i, t in rows)
    at = sharding.place(np.arange(333), 333, 2)
    assert got == Counter((i, n, c, int(p) % 7, int(p) // 7) for (i, c, n), p in zip(ordered, at, strict=True))
