"""Phrase collocations from count tries of bounded depth.

Each task counts the phrases of its blocks of text in tries no deeper than DEPTH words, one a language, and serialises each trie in sorted order. The
sorted pieces are dealt by ranges of prefixes and merged there, by adding what is equal. The trie of all texts is made a level a pass: a phrase
of LEAST occurrences has only parts with as many, so a block keeps below a node only what can be frequent. Blocks learn that from a
filter of the level before (BITS bits at most, whatever the data; what it passes in vain is counted and dropped).

A candidate's left parts are the nodes on the walk to it, its right parts the nodes that suffix links reach; both are equi-joins with the
nodes of the levels above. Its score is the lowest over its cuts, in exact arithmetic of 38 digits. Candidates that lie within a longer one
SHARE percent as frequent go.

Texts are lowered (A-Z), parted at PIECES and there into words at blanks. A null language is `und`, a null or empty text has no words. Repeated rows
count each. Only the named columns are read, so others may have any name. An empty table, or one without a candidate, gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import WordHasher, drop_written, mix, parts, released, session, text_chunks, written

DEPTH, LEAST, SHARE, TOP = 3, 10, 50, 2000
PIECES, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Words that a task holds before it serialises its tries.
BLOCK = 1 << 21
FEWEST_BITS, BITS, BITS_A_KEY = 1 << 20, 1 << 26, 16
MULTIPLIER = np.uint64(0xD1342543DE82EF95)


def _key(lang: str, *words: np.ndarray) -> np.ndarray:
    """A hash of a language and of words in a row, from their hashes."""
    x = np.uint64(zlib.crc32(lang.encode()) + 1)
    with np.errstate(over="ignore"):
        for h in words:
            x = mix(x * MULTIPLIER + h)
    return x


class Block:
    """The words of one language's texts."""

    def __init__(self):
        self.hashes, self.words, self.ids, self.links, self.n = [], [], [], [], 0

    def add(self, hasher: WordHasher, column: pa.Array) -> None:
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        ends_piece = np.zeros(256, bool)
        ends_piece[list(PIECES)] = True
        for _, _, data, bounds in text_chunks(column):
            h, s, e, first = hasher(data, bounds)
            if not len(h):
                continue
            cuts = np.zeros(len(data) + 1, np.int32)
            np.cumsum(ends_piece[data], out=cuts[1:])
            link = cuts[e[:-1]] == cuts[s[1:]]  # whether a word and the next are in one piece
            link[first[(first > 0) & (first < len(h))] - 1] = False
            u, at, ids = np.unique(h, return_index=True, return_inverse=True)
            size = e[at] - s[at]
            offsets = np.concatenate([[0], np.cumsum(size)])
            flat = low[data[np.repeat(s[at] - offsets[:-1], size) + np.arange(offsets[-1])]]
            self.words.append(pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)))
            self.ids.append(ids + sum(map(len, self.hashes)))
            self.hashes.append(u)
            self.links.append(np.append(link, False))
            self.n += len(h)

    def level(self, depth: int, lang: str, filters: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        """The phrases of `depth` words in sorted order, and their counts."""
        h, at, same = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        words = pa.concat_arrays(self.words).take(pa.array(at))
        order = pc.sort_indices(words).to_numpy()
        words, h, rank = words.take(pa.array(order)), h[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids, link = rank[same[np.concatenate(self.ids)]], np.concatenate(self.links)
        if depth == 1:
            return words, np.bincount(ids, minlength=len(words))
        often = _passes(filters[0], _key(lang, h))
        start = np.flatnonzero(link[:-1] & often[ids[:-1]] & often[ids[1:]])
        pair = ids[start] << 32 | ids[start + 1]
        u, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        first, second = u >> 32, u & 0xFFFFFFFF
        joined = lambda *x: pc.binary_join_element_wise(*[words.take(pa.array(i)) for i in x], pa.scalar(" ", pa.large_string()))
        if depth == 2:
            return joined(first, second), n
        often = _passes(filters[1], _key(lang, h[first], h[second]))[which]
        twice = np.flatnonzero(often[:-1] & often[1:] & (start[1:] == start[:-1] + 1))
        u, n = np.unique(which[twice] << 32 | ids[start[twice] + 2], return_counts=True)
        return joined(first[u >> 32], second[u >> 32], u & 0xFFFFFFFF), n


def _passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def tries(texts: DataFrame, depth: int, filters=()) -> DataFrame:
    """(lang, phrase, n) of texts(lang, text): a row for each phrase of `depth` words and each block that holds it, in the order of the block's trie."""

    def run(batches):
        hasher, held = WordHasher(PIECES + BLANKS), {}
        bits = [f.value for f in filters]

        def serialised():
            for lang in sorted(held):
                if held[lang].n:
                    phrases, n = held[lang].level(depth, lang, bits)
                    for i in range(0, len(n), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[i : i + 100_000])), phrases[i : i + 100_000].cast(pa.string()), pa.array(n[i : i + 100_000].astype(np.int64))], ["lang", "phrase", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(1).filter(pc.equal(langs.indices, k)) if len(langs.dictionary) > 1 else batch.column(1)
                held.setdefault(lang, Block()).add(hasher, own)
            if sum(b.n for b in held.values()) >= BLOCK:
                yield from serialised()
        yield from serialised()

    return texts.mapInArrow(run, "lang string, phrase string, n long")


def merged(pieces: DataFrame, name: str) -> DataFrame:
    """The tries' pieces, written as they are, then dealt by ranges of (lang, phrase) and added up."""
    pieces = written(pieces, f"{name}-pieces")
    dealt = pieces.repartitionByRange(parts(pieces.sparkSession), "lang", "phrase")
    out = written(dealt.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST if name != "words" else F.lit(True)), name)
    drop_written(pieces)
    released(pieces.sparkSession)
    return out


def frequent_bits(nodes: DataFrame, depth: int):
    """A broadcast filter of the nodes' (lang, phrase), BITS at most."""
    bits = FEWEST_BITS
    n = nodes.count()
    while bits < BITS and bits < BITS_A_KEY * n:
        bits *= 2

    def places(batches):
        hasher = WordHasher(BLANKS)
        for batch in batches:
            langs, at = batch.column(0).dictionary_encode(), []
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for _, _, data, bounds in text_chunks(batch.column(1).filter(pc.equal(langs.indices, k))):
                    h = hasher(data, bounds)[0].reshape(-1, depth)
                    at.append(_key(lang, *h.T) & np.uint64(bits - 1))
            at = np.concatenate([np.zeros(0, np.uint64), *at]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], ["which", "bit"])

    out = np.zeros(bits // 8, np.uint8)
    for r in nodes.select("lang", "phrase").mapInArrow(places, "which int, bit long").groupBy("which").agg(F.bitmap_construct_agg("bit").alias("b")).toLocalIterator():  # bits / 8 bytes in all
        out[r["which"] * 4096 : (r["which"] + 1) * 4096] = np.frombuffer(bytes(r["b"]), np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(out)


def scored(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """candidates(lang, phrase, a) with l, r and score of the cut of the lowest score, the first of equal ones."""
    cut = "transform(sequence(1, size(w) - 1), k -> named_struct('k', k, 'left', array_join(slice(w, 1, k), ' '), 'right', array_join(slice(w, k + 1, size(w) - k), ' ')))"
    x = candidates.withColumn("w", F.split("phrase", " ")).withColumn("c", F.explode(F.expr(cut))).select("lang", "phrase", "a", "c.*")
    walk = nodes.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    suffix = nodes.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    x = x.join(walk, ["lang", "left"]).join(suffix, ["lang", "right"])
    score = "cast(cast(1000000 as decimal(7, 0)) * (cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)"
    best = x.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a (its count), l and r (its parts'), n (the language's words), score."""
    session(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = merged(tries(texts, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [written(words.where(F.col("n") >= LEAST), "level")]
    filters = []
    for depth in range(2, DEPTH + 1):
        filters.append(frequent_bits(levels[-1], depth - 1))
        levels.append(merged(tries(texts, depth, tuple(filters)), f"level{depth}"))
    nodes = levels[0].unionByName(levels[1])
    a = F.col("n").alias("a")
    # Within a longer candidate lie what stands before its last word and after its first.
    inner = levels[2].select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "n")
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("m"))
    pairs = levels[1].join(inner, ["lang", "phrase"], "left").where(F.col("m").isNull() | (100 * F.col("m") < SHARE * F.col("n"))).select("lang", "phrase", a)
    x = scored(pairs.unionByName(levels[2].select("lang", "phrase", a)), nodes)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    x = x.withColumn("rank", rank).where(F.col("rank") <= top)
    return x.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
