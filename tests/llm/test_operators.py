"""Operators without a SQL form against brute force, and edge rows for all."""

import hashlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, language_id, line_dedup, mixing, sharding, token_counts, topk, toxicity, warc

# ---- sharding ----


@pytest.mark.parametrize("n", [1, 2, 7, 40, 1000, 12_345])
def test_place_is_a_permutation_with_an_inverse(n):
    p = sharding.place(np.arange(n), n, seed=5)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.place(p, n, seed=5, back=True).tolist() == list(range(n))


def test_shards_are_even_and_slots_gapless(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    a = sharding.shard(df, 40).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, sharding.shard(df.repartition(7), 40).collect()))
    by = Counter(r["shard"] for r in a)
    assert len(by) == 40 and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r["slot"] for r in a if r["shard"] == s) == list(range(by[s]))
    for r in a:
        text = f"é{r['doc_id']}".encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))


def test_shard_edges(edges, nothing):
    rows = sharding.shard(edges, 4).collect()
    assert len(rows) == 9 and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard(nothing, 4).count() == 0
    out = sharding.shard_rows(edges, 4)
    assert out.columns == [*edges.columns, "shard", "slot"] and out.count() == 9


# ---- mixing ----


def test_targets_fill_up_without_passing_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert t["a"] == 20 and t[None] == 0
    assert math.isclose(sum(t.values()), 1.5 * 2010)
    assert math.isclose(t["c"], 2 * t["b"], rel_tol=1e-9) or t["c"] == 2000


def test_mix_comes_near_targets_and_agrees(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3}" if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in a) == sorted((r["doc_id"], r["taken"]) for r in b)
    for s in {r["source"] for r in a}:
        own = [r for r in a if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 25
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in a)
    took = mixing.mix_rows(df)
    assert took.columns == df.columns
    assert Counter(r["doc_id"] for r in took.collect()) == Counter({r["doc_id"]: r["taken"] // r["size"] for r in a if r["taken"]})


def test_mix_edges(edges, nothing, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (8, None)], "doc_id long, quality int")
    rows = mixing.mix(edges, labels).collect()
    assert len(rows) == 9 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(nothing, labels).count() == 0
    assert mixing.mix_rows(edges, labels).where("doc_id in (1, 2, 3)").count() == 0


# ---- decontamination ----


def test_decontamination_finds_every_window(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(1, " ".join(words[50:75])), (2, "Short Item, here"), (3, None), (4, "..."), (5, " ".join(words[200:210])), (10, " ".join(words[50:75]))]
    docs = [(1, " ".join(words)), (2, " ".join(words[50:59])), (3, "a SHORT-item here b"), (4, None), (5, " ".join(["x", *words[52:64], "y"])), (5, "x"), (6, " ".join(words[200:210] * 3))]
    got = sorted(map(tuple, decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items", "items").collect()))
    assert got == [(1, 400, 35, 3, ["1", "10", "5"]), (2, 9, 0, 0, []), (3, 5, 3, 1, ["2"]), (4, 0, 0, 0, []), (5, 1, 0, 0, []), (5, 14, 12, 2, ["1", "10"]), (6, 30, 30, 1, ["5"])]


def test_decontamination_edges(edges, nothing, spark):
    items = spark.createDataFrame([(1, "long " * 12), (2, "word")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(edges, items).collect()}
    assert rows[8]["n_hit"] == 50_000 and rows[4]["contaminated"] and not rows[7]["contaminated"]
    assert rows[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(edges, empty).where("contaminated").count() == 0
    assert decontaminate.decontaminate(nothing, items).count() == 0
    assert sorted(r["doc_id"] or 0 for r in decontaminate.clean_rows(edges, items).collect()) == [0, 1, 2, 3, 7]


# ---- warc ----


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 100
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", big + "x"), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "x" * 600_000)]
    index = warc.write(warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html"))
    got = {r["record_id"]: r for r in warc.read(index).collect()}
    assert len(got) == 8
    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i]["payload_digest"] == hashlib.sha1(payload).hexdigest() and got[i]["payload_bytes"] == len(payload)
        if got[i]["record_type"] == "response":
            assert got[i]["payload"] == payload
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 2, None: 2}
    assert got[1]["url"] == "http://a/%20b" and got[2]["url"] is None
    assert warc.read(warc.write(warc.resolve(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html"))).count() == 0


def test_seek_table():
    data = b"abcdef" + warc.seek_table([(2, 5), (4, 9)])
    assert warc.read_seek_table(io.BytesIO(data), len(data)) == [(0, 2, 5), (2, 4, 9)]


# ---- token counts ----


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_equals_brute_force(rule):
    r = np.random.default_rng(1)
    for _ in range(200):
        ends = np.cumsum(r.integers(1, 6, r.integers(0, 20)))
        cuts = np.unique(r.integers(0, (ends[-1] if len(ends) else 1) + 1, 6))
        spans = np.array([(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if r.random() < 0.8], dtype=np.int64).reshape(-1, 2)
        want, start = np.zeros(len(spans) + 1), 0
        for e in ends:
            share = Counter(next((k for k, (a, b) in enumerate(spans) if a <= p < b), len(spans)) for p in range(start, e))
            if rule == "split":
                for k, m in share.items():
                    want[k] += m / (e - start)
            elif rule == "first":
                want[next((k for k, (a, b) in enumerate(spans) if a <= start < b), len(spans))] += 1
            else:
                inside = {k: m for k, m in share.items() if k < len(spans)}
                best = max(inside, key=lambda k: (inside[k], -k), default=len(spans))
                want[best if inside and inside[best] >= share.get(len(spans), 0) else len(spans)] += 1
            start = e
        assert np.allclose(token_counts.allocate(ends, spans, rule), want)


def test_counts_add_up(edges, nothing):
    rows = token_counts.count(edges).collect()
    by = Counter()
    for r in rows:
        by[r["doc_id"]] += r["n_tokens"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert 1 not in whole and whole[2] == 0 and by[8] == whole[8] > 0
    assert token_counts.count(nothing).count() == 0
    encoder = token_counts.Encoder(token_counts.load())
    text = "Añb\n\nc 🙂 d"
    assert encoder.ends(text)[-1] == len(text.encode())


# ---- line dedup ----


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\n\nc\nd\ny"), (3, "q\nq\nq\nq"), (4, "a\nb"), (5, None), (6, ""), (6, "a\nb\nc\nd")]
    got = {(r["doc_id"], r["n_removed"]): r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {(1, 0): "a\nb\nc\nd", (2, 3): "x\n\ny", (3, 3): "q", (4, 0): "a\nb", (5, 0): None, (6, 0): "", (6, 4): ""}


def test_line_dedup_edges(edges, nothing):
    assert line_dedup.dedup(edges).count() == 9 and line_dedup.dedup(nothing).count() == 0


# ---- language ----


def test_language_held_out(spark):
    r = np.random.default_rng(0)
    say = lambda parts, n: " ".join("".join(r.choice(parts, 3)) for _ in range(n))
    kinds = {"aa": ["tho", "ing", "wha", "ed"], "bb": ["sch", "ung", "kei", "ein"], "cc": ["que", "ado", "cio", "los"]}
    rows = [(i, say(kinds[k], 60), k) for i in range(150) for k in [list(kinds)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.learn(df.where("doc_id < 90"))
    got = language_id.identify(df.where("doc_id >= 90"), known).join(df, "doc_id").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in got) >= 0.98 * len(got)
    assert all(0 <= x["score"] <= 1 for x in got)
    strict = language_id.identify(df, known, least_margin=1e9).collect()
    assert {x["lang_pred"] for x in strict} == {"und"} and {x["nearest"] for x in strict} == set(kinds)


def test_language_edges(edges, nothing):
    known = language_id.learn(edges)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edges, known).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"
    assert {r["lang_pred"] for r in language_id.identify(edges, {}).collect()} == {"und"}
    assert language_id.learn(nothing) == {} and language_id.identify(nothing, known).count() == 0


# ---- toxicity ----


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_edit_distance():
    r = np.random.default_rng(2)
    terms, stems = ["idiot", "stupid", "lösern", "scum"], ["vequ"]
    a = toxicity.Automaton(terms, stems)
    words = [*terms, "vequation", "vequ", "veq"]
    for w in list(words):
        for _ in range(300):
            x = list(w)
            for _ in range(r.integers(1, 3)):
                k = r.integers(0, 3)
                at = int(r.integers(0, len(x) + (k == 1)))
                if k == 0 and len(x) > 1:
                    del x[min(at, len(x) - 1)]
                elif k == 1:
                    x.insert(at, str(r.choice(list("aiotñß"))))
                else:
                    x[min(at, len(x) - 1)] = str(r.choice(list("aiotñß")))
            words.append("".join(x))
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    n, kinds = a.match(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1]), ends)
    got = dict(zip(n.tolist(), kinds.tolist(), strict=True))
    for i, w in enumerate(words):
        if w in terms:
            want = 1
        elif w.startswith("vequ"):
            want = 2
        else:
            want = 3 if min(distance(w, t) for t in terms if len(t) >= toxicity.MIN_FUZZY) <= 1 else 0
        assert got.get(i, 0) == want, w


def test_quotation():
    text = 'he said "you idiot here" and idiot'.encode()
    at = text.index(b"idiot")
    assert toxicity.quoted(text, at, at + 5)
    at = text.rindex(b"idiot")
    assert not toxicity.quoted(text, at, at + 5)


def test_toxicity_learns(spark):
    r = np.random.default_rng(0)
    say = lambda n: ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        w = say(40)
        if i % 6 == 0:
            for _ in range(3):
                w.insert(int(r.integers(0, 40)), str(r.choice(["zounds", "knavish"])))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 5 != 0"))
    assert model.automaton.terms == ["knavish", "zounds"]
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    more = spark.createDataFrame([(1, "some zouands and zound here knavissh"), (2, 'a "zounds" b'), (3, None), (4, "")], "doc_id long, text string")
    x = {y["doc_id"]: y for y in toxicity.score(more, model).collect()}
    assert x[1]["predicted"] == 1 and x[1]["misspelled"] == 3 and x[2]["quoted"] == 1 and x[2]["score"] < x[1]["score"] and x[3]["score"] == x[4]["score"] < 0.5
    assert toxicity.clean_rows(docs, model).count() == 500


def test_toxicity_edges(edges, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(edges, none)
    assert toxicity.score(edges, model).where("predicted = 1").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    one = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score(edges, toxicity.learn(edges, one)).count() == 9


# ---- top-k ----


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    r = np.random.default_rng(0)
    vecs = r.normal(size=(500, 24)) / 5
    vecs[100:120] = vecs[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(500, None), (501, [float("nan")] * 24), (502, [None] * 24), (503, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    m = np.floor(64 * vecs).astype(np.int64)
    want = set()
    for q in range(0, 500, 20):
        s = m @ m[q]
        best = sorted((i for i in range(500) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, k + 1, i, int(s[i])) for k, i in enumerate(best)}
    assert set(map(tuple, got)) == want


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>, score string"
    few = spark.createDataFrame([(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (1, [0.5, 2.0], "x"), (None, [3.0, 0.0], "x"), (2, [1.0], "x")], schema)
    got = sorted(map(tuple, topk.top_k(few, F.col("vec_id") == 0).collect()), key=str)
    assert got == sorted([(0, 1, None, 192 * 64), (0, 2, 0, 4096), (0, 3, 1, 2048)] * 2, key=str)
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
