"""Very long texts, and texts of repeated words, for the operators that read them in Python or join their parts."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, sharding, token_counts, toxicity

# ---- tokens ----


def test_cut_and_whole_encoding_agree():
    vocabulary, r = token_counts.load(), random.Random(5)
    cut, whole = token_counts.Encoder(vocabulary, long=3), token_counts.Encoder(vocabulary, long=10**9)
    for _ in range(400):
        text = "".join(r.choice(["a", "é", "Word", "12", "'s", "-+", "\n", " ", "\t", "　", "\xa0", "\x1c", " " * 5, "\n \n\n"]) for _ in range(r.randrange(25)))
        assert cut.encode(text) == whole.encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" + " " * 3_000_000 + "b", "\n" * 1_000_000, "x" * 1_000_000, "-+" * 500_000, "9" * 300_000], ids=["blanks", "lines", "letters", "signs", "digits"])
def test_long_runs_end(text):
    ends = token_counts.Encoder(token_counts.load()).ends(text)
    assert ends[-1] == len(text.encode())


def test_counts_equal_brute_force(spark):
    """The query's rows: tokens found one by one, each given to the line that holds most of its bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in token_counts.count(docs).collect()}
    encoder = token_counts.Encoder(token_counts.load())
    want = {}
    for doc, text in docs.collect():
        lines = re.findall(rb"[^\n]*\n|[^\n]+", text.encode()) or [b""]
        of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        want |= {(doc, i): 0.0 for i in range(len(lines))}
        at = 0
        for token in encoder.encoding.encode_ordinary(text):
            n = len(encoder.encoding.decode_single_token_bytes(token))
            held = np.bincount(of[at : at + n])
            want[doc, int(held.argmax())] += 1
            at += n
    assert got == want


# ---- toxicity ----


def test_many_hits_on_one_line():
    scanner = toxicity.Scanner(toxicity.Automaton(["idiot"], []))
    import pyarrow as pa

    scanner(pa.array(["idiot"]))
    t = time.perf_counter()
    sums, _ = scanner(pa.array(['"idiot" ' * 16_000, "idiot"]))
    assert time.perf_counter() - t < 5
    assert sums[0].tolist()[:4] == [16_000, 0, 0, 16_000] and sums[1].tolist()[:4] == [1, 0, 0, 0]


def test_marks_equal_a_plain_search():
    r = random.Random(8)

    def plain(text, s, e):
        begin, end = text.rfind(b"\n", 0, s) + 1, text.find(b"\n", e)
        before = list(toxicity.QUOTES.finditer(text, begin, s))
        after = toxicity.QUOTES.search(text, e, min(e + toxicity.WINDOW, end if end >= 0 else len(text)))
        return bool(len(before) % 2 and after and s - before[-1].end() <= toxicity.WINDOW)

    for _ in range(300):
        text = "".join(r.choice(['"', "“", "”", "«", "\n", "idiot ", "word ", " " * 30]) for _ in range(r.randrange(1, 40))).encode()
        for m in re.finditer(b"idiot", text):
            assert toxicity.quoted(text, *m.span()) == plain(text, *m.span())


def test_a_learned_model_needs_edits_and_windows(spark):
    """Held-out documents with planted misspellings and quotations are judged otherwise without edits, or without windows."""
    r = random.Random(11)
    say = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        w = say(30)
        for _ in range(3 * toxic):
            w.insert(r.randrange(30), r.choice(["wretchling", "scoundrel"]))
        if not toxic and i % 5 == 1:
            w += ['"you wretchling"', "he", "said"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    for i in range(500, 520):
        rows.append((i, " ".join([*say(10), "wretchlong", "scoundrrel", *say(10), "wretchlin"])))
    for i in range(520, 540):
        rows.append((i, " ".join([*say(10), 'she called it a "scoundrel"', *say(10)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    a = model.automaton
    judge = lambda m: {x["doc_id"]: x["predicted"] for x in toxicity.score(docs.where("doc_id >= 500"), m).collect()}
    whole = judge(model)
    assert all(whole[i] == 1 for i in range(500, 520)) and all(whole[i] == 0 for i in range(520, 540))
    exact = judge(toxicity.Model(toxicity.Automaton(a.terms, a.stems, a.benign, {*a.terms, *a.stems}), model.slope, model.intercept))
    assert not any(exact[i] for i in range(500, 520))


# ---- decontamination ----


def test_repeated_words_against_a_repeating_item(spark):
    item = " ".join(["a"] * 2000)
    docs = spark.createDataFrame([(1, " ".join(["a"] * 5000)), (2, " ".join(["a"] * 9)), (3, " ".join(["b", "a"] * 300)), (4, "x " + " ".join(["a"] * 10) + " y")], "doc_id long, text string")
    assert decontaminate.item_grams(spark.createDataFrame([(7, item)], "item_id long, text string"), []).count() < 40
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (5000, ["7"]), 2: (0, []), 3: (0, []), 4: (10, ["7"])}


# ---- languages ----


def test_numerals_are_no_letters(spark):
    known = {"de": b"der die das und", "en": b"the and of"}
    docs = spark.createDataFrame([(1, "½ ² ③ 12 _"), (2, "½ é"), (3, "٣٤"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, known).collect()}
    assert got[1] == got[3] == got[4] == "und" and got[2] != "und"


# ---- all ----


def test_a_megabyte_of_text_in_each(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "\n".join(["one line"] * 50_000)), (3, "short text")], "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert ngram_join.join(docs).count() == 3
    assert line_dedup.dedup(docs).where("doc_id = 2").first()["n_removed"] == 49_999
    assert sharding.shard(docs, 2).count() == 3
    assert mixing.mix(docs, labels).agg(F.sum("size")).first()[0] == 300_002
    assert token_counts.count(docs).where("doc_id = 2").count() == 50_000
    assert {r["lang_pred"] for r in language_id.identify(docs, {"en": b"word one line"}).collect()} == {"en"}
