"""The pipeline's stages, each on what the one before kept, against brute force on the smallest tables."""

import re
from collections import Counter

import duckdb
import pytest
from test_ngram_join import brute

import corpus_pipeline
from granary.llm import mixing
from granary.llm.queries import table

D = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, D, "documents"), [table(spark, D, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_toxic_documents_go(stages):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{D}/labels.parquet'").fetchall())
    kept = {r["doc_id"] for r in stages[1].collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_one_of_each_component_stays(stages):
    groups = brute([(r["doc_id"], r["text"]) for r in stages[1].collect()])
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_contaminated_documents_go(spark, stages):
    windows = set()
    for r in table(spark, D, "benchmark").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    dirty = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert {r["doc_id"] for r in stages[3].collect()} == {r["doc_id"] for r in stages[2].collect() if not dirty(r["text"])}


def test_mix_takes_rows_as_decided(spark, stages):
    decided = {r["doc_id"]: r for r in mixing.mix(stages[3], table(spark, D, "labels")).collect()}
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert got == Counter({i: r["taken"] // r["size"] for i, r in decided.items() if r["taken"]})


def test_shards_hold_every_row_once(stages):
    rows = stages[5].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in stages[4].collect())
    by = Counter(r["shard"] for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in by.items())
