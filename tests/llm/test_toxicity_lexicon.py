"""The lexicon under copies of one document."""

import numpy as np

from granary.llm import toxicity


def test_copies_of_a_document_do_not_crowd_out_terms(spark):
    r = np.random.default_rng(0)
    say = lambda n, letters="abcdefghij", k=6: ["".join(r.choice(list(letters), k)) for _ in range(n)]
    rows = []
    for i in range(600):
        w = say(40)
        if i % 6 == 0:
            for _ in range(3):
                w.insert(int(r.integers(0, 40)), str(r.choice(["zounds", "knavish"])))
        rows.append((" ".join(w), int(i % 6 == 0)))
    # 300 distinct long words and a term, in more toxic rows than the terms are: some 2,000 forms.
    copied = " ".join(say(300, "klmnopqrst", 11) + ["zounds"])
    want = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows + [(copied, 1)] * 110, "text string, toxic int"))
    assert want == got == (["knavish", "zounds"], [])


def test_terms_with_a_stem_take_edits(spark):
    r = np.random.default_rng(0)
    say = lambda n, letters="abcdefghij", k=6: ["".join(r.choice(list(letters), k)) for _ in range(n)]
    rows = []
    for i in range(600):
        w = say(40)
        if i % 6 == 0:
            w.insert(int(r.integers(0, 40)), "zoundrel" if i % 12 == 0 else "zoundr" + say(1, k=4)[0])
        rows.append((" ".join(w), int(i % 6 == 0)))
    terms, stems = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert terms == ["zoundrel"] and stems == ["zoundr"]
    automaton = toxicity.Automaton(terms, stems)
    words = [b"zoundrel", b"zoundrabc", b"zaundrel", b"zundrel", b"other"]
    at = np.cumsum([0, *map(len, words)])
    assert [x.tolist() for x in automaton.match(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])] == [[0, 1, 2, 3], [1, 2, 3, 3]]


def test_weights_stand_for_repeated_rows():
    r = np.random.default_rng(0)
    x, n = r.random(50), r.integers(1, 6, 50)
    y = (x + r.normal(0, 0.3, 50) > 0.5).astype(float)
    assert np.allclose(toxicity.fit(x, y, n=n.astype(float)), toxicity.fit(np.repeat(x, n), np.repeat(y, n)))
