"""Collocations, substring dedup and spelling variants: SQL, brute force, edge rows."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from granary.llm import phrases, queries, substrings, variants

DATA = "/root/testdata/sf0.001"


# ---- the subpackage's SQL ----


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    queries.queries()[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    got = f"'{tmp_path}/out/*.parquet'"
    duck.execute(f"CREATE TABLE want AS {queries.oracle_sql()[name]}")
    names = ", ".join(sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall()))
    for a, b in (("want", got), (got, "want")):
        assert duck.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []


# ---- collocations ----


def brute_phrases(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = (text or "").translate(str.maketrans(variants.UPPER, variants.LOWER))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(len(q) == 3 and m == lang and c >= least and p in (q[:2], q[1:]) and 100 * c >= 50 * a for (m, q), c in f.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def test_collocations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 100)
    rng = random.Random(1)
    rows = [(rng.choice([None, "en", "und", "fr"]), " ".join(rng.choice(["A", "b", "ç", "d\t", "e.", "b,", "x\nb"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", None), (None, ""), ("en", " \t.\n"), ("fr", "Zz " * 40), ("en", "new york city. new york, " * 12)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 3_000_000_021, 3_000_000_077
    nodes = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, n long")
    got = phrases.scored(spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long"), nodes).first()
    assert got["score"] == 1_000_000 * a * a // (left * right)


def test_collocation_edges(spark, edges, nothing):
    assert phrases.collocations(nothing).collect() == []
    got = {(r["lang"], r["phrase"]): r for r in phrases.collocations(edges).collect()}
    assert got["en", "long long long"]["a"] == 49_998 and got["en", "long long long"]["n"] == 50_002
    assert set(got) == {("en", "long long long")}  # the pair lies within it as often


# ---- substring dedup ----


def brute_substrings(rows, window):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone |= set(range(i, i + window))
            seen.add(x)
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram", "group"), [(20, 6, 200_000), (5, 2, 200_000), (5, 2, 20), (20, 6, 3), (1, 1, 2)])
def test_substrings_equal_brute_force(spark, window, gram, group):
    rng = random.Random(window)
    vocabulary = [chr(97 + i) + "é" for i in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
        rows.append((i if i % 9 else None, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100 + i, "same words in each of them " * 5) for i in range(9)] + [(200, None), (201, ""), (202, " \n "), (203, "aé " * 300)]
    rows = [(d, t) for k, (d, t) in enumerate(rows) if d is not None or k == 0]  # the order of two null ids is open
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window, gram=gram, group=group).collect()
    kept = [(r["doc_id"], r["n_words"], r["n_removed"], " ".join((r["text"] or "").split())) for r in got]
    assert sorted(kept, key=str) == brute_substrings(rows, window)
    for r in got:
        assert sum(x["end"] - x["begin"] for x in r["removed"]) == r["n_removed"]


def test_substring_edges(spark, edges, nothing):
    assert substrings.dedup(nothing).collect() == []
    got = substrings.dedup(edges.withColumnRenamed("lang", "N_words")).collect()
    assert len(got) == 9 and {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got}[8] == (50_000, 49_999)
    assert "N_words" not in got[0].asDict()


def test_shown_grams_meet_in_every_common_window():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 30, 400).astype(np.uint64)
    g, at = substrings.shown(h, 8, 3)
    assert all(any(i <= p <= i + 5 for p in at.tolist()) for i in range(len(h) - 7))
    assert (substrings.codes(h, 3)[at] == g).all()


# ---- spelling variants ----


def brute_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if a == b or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: min(x, key=lambda y: (-words[y], y)) for w, x in others.items() if x}
    form = {w: f for w, f in form.items() if words[f] >= 10 * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, words[w], len(others[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(20_000, 4096), (3, 2)])
def test_variants_equal_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    rng = random.Random(shard)
    stems = ["Example", "straßen", "letters", "éléments", "ööööööö", "aaaaaaaa", "abababab"]

    def word():
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            i, c = rng.randrange(len(w) + 1), rng.choice("aétx")
            w[i : i + rng.randrange(2)] = [c] * rng.randrange(2)
        return "".join(w)

    rows = [(i if i % 7 else None, rng.choice([" ", "1", "÷-"]).join(word() for _ in range(40))) for i in range(60)] + [(1, None), (2, ""), (3, "z" * 5_000), (4, "z" * 5_000), (5, "z" * 4_999 + " " + "z" * 4_999)]
    got = variants.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard=shard)
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute_variants(rows)


def test_variants_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    got = variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute_variants(rows)


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "b")], "word string, form string")
    assert {tuple(r) for r in variants.roots(forms).collect()} == {(w, "e") for w in "abcdx"}


def test_variant_edges(nothing, edges):
    assert variants.variants(nothing).collect() == []
    assert variants.variants(edges).collect() == []  # no word of seven code points
