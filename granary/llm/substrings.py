"""Substring dedup by suffix trees over words, partitioned by prefixes of variable length.

A suffix is what follows a place of a document, word by word; two occurrences of the same WINDOW words are two leaves below one node of
depth WINDOW of the tree of all suffixes. That node's first leaf, in the order of (doc_id, place), stays; each later one covers its
WINDOW words, covered places are merged, and those words go.

The tree is never in one place. First the suffixes that can't reach a deep node are left out: each window shows its smallest hash of GRAM
words, and a window whose shown gram occurs once in all documents is unique. Whole documents with equal words are one text. The other
suffixes are split by their first word, by more words where a prefix has over `group` suffixes, and so on (LENGTHS): a prefix's suffixes are a group
that one task holds and sorts. Of a prefix that has more of them even at WINDOW words, all leaves lie below one deep node, so its first leaf is found by partial
aggregation and the others are told by a table of at most N / group such nodes. A group is sorted by the path from the prefix to
depth WINDOW (two 64-bit hashes of its words), which puts the leaves of each deep node side by side.

Rows are numbered once and written, so that all steps speak of the same rows. Documents with fewer than WINDOW words, null and empty
texts lose nothing. Repeated rows are documents of their own, a null doc_id comes after all others. Other columns may have any name; those
named like a result column give way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import WHITE, WordHasher, marked, mix, parts, released, session, text_chunks, written

WINDOW, GRAM = 20, 6
#: Words of a prefix, tried in this order.
LENGTHS = (1, 2, 4, 8, 16)
#: Suffixes of a group: 10 MB of them.
GROUP = 200_000
RESULT = ("n_words", "n_removed", "kept_sha256", "removed")
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def codes(h: np.ndarray, n: int, base: int = 0) -> np.ndarray:
    """A hash of each n hashes in a row."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * BASES[base] + h[i : i + len(out)]
        return mix(out + np.uint64(n))


def _over(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) of each n values in a row."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def shown(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the grams that windows show: in each window the smallest, at all its places."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, int)
    g, n = codes(h, gram), window - gram + 1
    least = _over(g, n, np.minimum)
    # A place is shown if one of the windows that hold it has its gram as the smallest.
    edge = np.zeros(n - 1, np.uint64)
    at = np.flatnonzero(_over(np.concatenate([edge, least, edge]), n, np.maximum) == g)
    return g[at], at


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *[v.view(kind) if v.dtype.itemsize == np.dtype(kind).itemsize else v.astype(kind) for v in values]])))


def _printed(window: int, gram: int):
    @F.arrow_udf("struct<n: int, sha: binary, grams: array<bigint>, places: array<int>>")
    def printed(texts: pa.Array) -> pa.Array:
        hasher, n, sha, grams, places = WordHasher(WHITE, lower=False), [], [], [], []
        for i, j, data, bounds in text_chunks(texts):
            h, _, _, first = hasher(data, bounds)
            raw = data.tobytes()
            for k in range(j - i):
                own = h[first[k] : first[k + 1]]
                n.append(len(own))
                sha.append(hashlib.sha256(b" ".join(raw[bounds[k] : bounds[k + 1]].split())).digest())
                g, at = shown(own, window, gram)
                grams.append(g)
                places.append(at)
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(sha, pa.binary()), _lists(grams, np.int64), _lists(places, np.int32)], ["n", "sha", "grams", "places"])

    return printed


def _repeated_places(prints: DataFrame, hot: int) -> DataFrame:
    """(number, places): where each row shows grams that are shown elsewhere too."""
    shows = prints.select("number", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("number", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    repeated = written(shows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    often = F.broadcast(repeated.where(F.col("n") > hot).select("gram", F.lit(True).alias("often")))  # total / hot at most
    x = marked(shows.join(often, "gram", "left"), repeated, "gram", "maybe").where("maybe")
    rest = x.where("often is null").join(repeated.select("gram").hint("merge"), "gram")
    return x.where("often").select("number", "place").unionByName(rest.select("number", "place")).groupBy("number").agg(F.collect_list("place").alias("places"))


RUN = "number long, doc {}, start int, words array<bigint>"


def _runs(texts: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """texts(number, doc, text, places) to runs of suffixes: the word hashes from the first window's start to the last one's end."""

    def run(batches):
        hasher = WordHasher(WHITE, lower=False)
        for batch in batches:
            number, start, words = [], [], []
            places = batch.column(3).to_pylist()
            for i, j, data, bounds in text_chunks(batch.column(2)):
                h, _, _, first = hasher(data, bounds)
                for k in range(i, j):
                    own = h[first[k - i] : first[k - i + 1]]
                    begins = np.zeros(len(own) - window + 2, int)
                    at = np.array(places[k])
                    np.add.at(begins, np.clip(at - (window - gram), 0, len(own) - window + 1), 1)
                    np.add.at(begins, np.minimum(at, len(own) - window) + 1, -1)
                    held = np.concatenate([[0], np.cumsum(begins)[:-1] > 0, [0]]).astype(np.int8)
                    for a, b in np.flatnonzero(np.diff(held)).reshape(-1, 2).tolist():
                        number.append(k)
                        start.append(a)
                        words.append(own[a : b + window - 1])
            rows = pa.array(number, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start, pa.int32()), _lists(words, np.int64)], ["number", "doc", "start", "words"])

    return texts.mapInArrow(run, RUN.format(kind))


def _hashes(column: pa.Array):
    """The word hashes of each run."""
    at, data = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted few."""
    if not len(few):
        return np.zeros(len(x), bool)
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x


def _prefixes(h: np.ndarray, window: int, large: list[np.ndarray], lengths) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the code of its shortest prefix that isn't large, and whether all are."""
    n = len(h) - window + 1
    group, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for length, few in zip(lengths, large, strict=False):
        x = codes(h, length)[:n]
        group[open_] = x[open_]
        open_ &= _among(x, few)
        if not open_.any():
            break
    return group, open_


def large_prefixes(runs: DataFrame, window: int, group: int, lengths=LENGTHS) -> list[np.ndarray]:
    """For each length the codes of the prefixes with over `group` suffixes, sorted; N / group of them at most."""
    large: list[np.ndarray] = []
    for length in lengths:
        known = list(large)

        def count(batches, known=known, length=length):
            for batch in batches:
                found = []
                for h in _hashes(batch.column(0)):
                    x = codes(h, length)[: len(h) - window + 1]
                    found.append(x[_prefixes(h, window, known, lengths)[1]] if known else x)
                x, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

        got = runs.select("words").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > group).select("code").collect()
        large.append(np.sort(np.array([r["code"] for r in got], np.int64).view(np.uint64)))
        if not got:
            break
    return large


def suffixes(runs: DataFrame, kind: str, window: int, large: list[np.ndarray], lengths=LENGTHS) -> DataFrame:
    """A row for each suffix of the runs: its group (null: no prefix is small enough), path (a, b), number, doc, place."""

    def split(batches):
        for batch in batches:
            hs = _hashes(batch.column(3))
            sizes = np.array([len(h) - window + 1 for h in hs], int)
            rows = pa.array(np.repeat(np.arange(len(hs)), sizes))
            first = np.repeat(batch.column(2).to_numpy(), sizes)
            place = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if len(hs) else first
            each = [(*_prefixes(h, window, large, lengths), codes(h, window, 0), codes(h, window, 1)) for h in hs]
            group, open_, a, b = (np.concatenate([np.zeros(0, t), *[e[i] for e in each]]) for i, t in enumerate((np.uint64, bool, np.uint64, np.uint64)))
            group = pa.array((group >> np.uint64(40)).astype(np.int32), mask=open_)
            yield pa.RecordBatch.from_arrays([group, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place.astype(np.int32))], ["grp", "a", "b", "number", "doc", "place"])

    return runs.mapInArrow(split, f"grp int, a long, b long, number long, doc {kind}, place int")


def later_leaves(leaves: DataFrame, many: bool) -> DataFrame:
    """(number, place) of the leaves below deep nodes, but for each node's first one. many: some leaves have no group."""
    order = [F.col("doc").asc_nulls_last(), F.col("number"), F.col("place")]
    small = leaves.where("grp is not null") if many else leaves
    # One task sorts a group: the exchange by groups serves the window too.
    dealt = small.repartition(parts(leaves.sparkSession), "grp")
    out = dealt.withColumn("leaf", F.row_number().over(W.partitionBy("grp", "a", "b").orderBy(*order))).where("leaf > 1").select("number", "place")
    if not many:
        return out
    rest, first = leaves.where("grp is null"), F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "number", "place")).alias("first")
    nodes = written(rest.groupBy("a", "b").agg(first), "nodes")  # of more than `group` leaves each
    met = rest.join(F.broadcast(nodes), ["a", "b"]).where((F.col("number") != F.col("first.number")) | (F.col("place") != F.col("first.place")))
    return out.unionByName(met.select("number", "place"))


def _shortened(window: int):
    @F.arrow_udf("struct<text: string, sha: string, removed: array<struct<begin: int, end: int>>>")
    def shortened(texts: pa.Array, places: pa.Array) -> pa.Array:
        text, sha, removed = [], [], []
        for t, at in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            gone = np.zeros(len(words) + 1, int)
            np.add.at(gone, np.array(at, int), 1)
            np.add.at(gone, np.array(at, int) + window, -1)
            covered = np.concatenate([[0], np.cumsum(gone)[:-1] > 0, [0]]).astype(np.int8)
            spans = np.flatnonzero(np.diff(covered)).reshape(-1, 2).tolist()
            ends = [0, *[x for s in spans for x in s], len(words)]
            left = b" ".join(w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b])
            text.append(left.decode("utf-8", "replace"))
            sha.append(hashlib.sha256(left).hexdigest())
            removed.append([{"begin": a, "end": b} for a, b in spans])
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(sha, pa.string()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], ["text", "sha", "removed"])

    return shortened


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """docs with the text as it is left (of a text that lost words, the kept ones a space apart), and n_words, n_removed, kept_sha256 (of the kept words a space apart), removed (spans of words, from 0)."""
    if not 1 <= gram <= window:
        raise ValueError("a gram has between one word and a window's")
    spark = session(docs.sparkSession)
    lengths = [x for x in LENGTHS if x < window] + [window]
    own = [c for c in docs.columns if c.lower() not in RESULT]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*own).alias("row"))
    rows = written(rows.withColumn("p", _printed(window, gram)(F.col(f"row.`{text}`"))), "numbered", compression="zstd")
    doc = F.col(f"row.`{id_col}`").alias("doc")

    # One row of each text goes on; the words of its copies are all covered.
    order = F.struct(F.col("doc").isNull().alias("x"), "doc", "number")
    long = rows.where(F.col("p.n") >= window)
    firsts = written(long.select("number", doc, "p.sha").groupBy("sha").agg(F.min(order)["number"].alias("number")).select("number"), "firsts")
    copies = written(long.select("number").join(firsts, "number", "left_anti"), "copies")
    hidden = marked(long.select("number", "p.grams", "p.places"), copies, "number", "maybe")
    prints = hidden.where("not maybe").drop("maybe").unionByName(hidden.where("maybe").drop("maybe").join(copies.hint("merge"), "number", "left_anti"))
    places = written(_repeated_places(prints, group), "places")
    released(spark)

    texts = marked(rows.select("number", doc, F.col(f"row.`{text}`").alias("text")), places, "number", "maybe").where("maybe").drop("maybe").join(places.hint("merge"), "number")
    runs = written(_runs(texts.select("number", "doc", "text", "places"), kind, window, gram), "runs")
    released(spark)
    large = large_prefixes(runs, window, group, lengths)
    leaves = suffixes(runs, kind, window, large, lengths)
    later = later_leaves(leaves, len(large) == len(lengths) and len(large[-1]) > 0)
    gone = written(later.groupBy("number").agg(F.collect_list("place").alias("at")), "gone")
    released(spark)

    # What neither is a copy nor lost words stays where it is.
    touched = gone.select("number", "at").unionByName(copies.select("number", F.lit(None).cast("array<int>").alias("at")))
    body = F.col(f"row.`{text}`")
    spans = "array<struct<begin: int, end: int>>"
    as_is = lambda x: [x.alias(c) if c == text else F.col(f"row.`{c}`") for c in own]
    maybe = marked(rows.withColumn("n", F.col("p.n").cast("long")).withColumn("sha", F.lower(F.hex("p.sha"))).drop("p"), touched, "number", "maybe")
    met = maybe.where("maybe").drop("maybe").join(touched.withColumn("t", F.lit(True)).hint("merge"), "number", "left")
    same = maybe.where("not maybe").select("row", "n", "sha").unionByName(met.where("t is null").select("row", "n", "sha"))
    same = same.select(*as_is(body), F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.array().cast(spans).alias("removed"))
    whole = met.where("t and at is null").select(*as_is(F.lit("")), F.col("n").alias("n_words"), F.col("n").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.array(F.struct(F.lit(0).alias("begin"), F.col("n").cast("int").alias("end"))).cast(spans).alias("removed"))
    cut = met.where("at is not null").withColumn("left", _shortened(window)(body, F.col("at")))
    n_removed = F.aggregate("left.removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    cut = cut.select(*as_is(F.col("left.text")), F.col("n").alias("n_words"), n_removed.alias("n_removed"), F.col("left.sha").alias("kept_sha256"), F.col("left.removed").alias("removed"))
    return same.unionByName(whole).unionByName(cut)
