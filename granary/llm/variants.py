"""Spelling variants: words within one edit of each other, found by walking each word's Levenshtein automaton with shards of a trie.

The dictionary is counted from all texts: runs of letters in small letters (A-Z only), of which a share loses a code point by a hash of document and
run; words of MIN_LENGTH code points or more that occur MIN_COUNT times are kept. Two words are near if one inserted, deleted or replaced code
point makes one the other.

All shards together are as large as the dictionary, which has no bound, so a shard goes only to the words that can meet it. Two near words
share their first HEAD code points, or else their last TAIL (an edit within the first HEAD leaves at least so many of MIN_LENGTH alone). Each word is an
entry of the trie of its beginning, and in reverse of the trie of its end; the words of a beginning or an end are a cell. A cell with over
`shard` words is cut into shards by a hash and its words into as many blocks, and each shard is sent to each of the cell's blocks. A task takes
cells one after another, small ones together as branches below one root.

A trie is two sorted arrays (edges by parent and code point, and the word that ends at a node). The automaton of a word has the states (place, edits) with
at most one edit. Automata of a block of words walk down together; whatever takes its edit at a place is followed to the end
before the walk goes on, so few states are alive. Accepted pairs are counted for each word with its best form, and these partial results are summed.

Null texts have no words, a null doc_id hashes as an empty one. Repeated rows count each. Only the named columns are read, so others may
have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import parts, released, session, written

MIN_LENGTH, MIN_COUNT, RATIO, ERASE = 7, 2, 10, 31
HEAD, TAIL = 3, 4
#: Words of a trie shard (a few MB), and automata that walk together.
SHARD, BLOCK = 20_000, 4_096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dictionary(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    # Shorter runs can't give a word, and a run is matched whole.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{MIN_LENGTH},}})"), F.lit(1))
    x = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    x = x.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    x = x.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = "cast(h % length(run) as int)"
    word = F.when(F.col("h") % ERASE == 0, F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")).otherwise(F.col("run"))
    return x.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


class Trie:
    """A trie of code point sequences, which must be sorted and differ."""

    def __init__(self, entries: list[list[int]]):
        parent, char = [], []
        path: list[int] = [0]
        before: list[int] = []
        self.word = [-1]
        for k, own in enumerate(entries):
            same = 0
            for a, b in zip(before, own, strict=False):
                if a != b:
                    break
                same += 1
            first = len(self.word)
            new = len(own) - same
            parent += [path[same], *range(first, first + new - 1)]
            char += own[same:]
            self.word += [-1] * (new - 1) + [k]
            path[same + 1 :] = range(first, first + new)
            before = own
        parent_, char_ = np.array(parent, np.int64), np.array(char, np.int64)
        order = np.lexsort((char_, parent_))
        self.char, self.child = char_[order], order + 1  # a node's edge is made with it
        self.key = (parent_[order] << 24) | self.char
        self.begin = np.searchsorted(parent_[order], np.arange(len(self.word) + 1))
        self.word = np.array(self.word)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The children by these code points, -1 where there is none."""
        if not len(self.key):
            return np.full(len(node), -1)
        want = (node << 24) | char
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.child[at], -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges below the nodes: which of the nodes, and which edge."""
        n = self.begin[node + 1] - self.begin[node]
        of = np.repeat(np.arange(len(node)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.begin[node][of]


def neighbours(trie: Trie, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, entry) for each entry that one edit makes of a word. Words are flat[begin : begin + size]; no edit is taken before the place `exact`."""
    found_q, found_k = [np.zeros(0, int)], [np.zeros(0, int)]
    q, node, at = np.arange(len(begin)), np.zeros(len(begin), int), 0
    while len(q):
        more = at < size[q]
        here = np.where(more, flat[np.minimum(begin[q] + at, len(flat) - 1)], -1)
        may = np.flatnonzero(at >= exact[q])
        if len(may):
            of, edge = trie.children(node[may])
            of = may[of]
            other = trie.char[edge] != here[of]
            of, edge = of[other], edge[other]
            # Of equal code points in a row the last is left out, as any other gives the same word.
            after = np.where(at + 1 < size[q], flat[np.minimum(begin[q] + at + 1, len(flat) - 1)], -1)
            replaced, erased = more[of], may[more[may] & (after[may] != here[may])]
            # States with one edit: an added code point, another one, or one left out.
            w = np.concatenate([q[of], q[of[replaced]], q[erased]])
            v = np.concatenate([trie.child[edge], trie.child[edge[replaced]], node[erased]])
            p = np.concatenate([np.full(len(of), at), np.full(int(replaced.sum()) + len(erased), at + 1)])
            while len(w):
                over = p >= size[w]
                k = trie.word[v[over]]
                found_q.append(w[over][k >= 0])
                found_k.append(k[k >= 0])
                w, v, p = w[~over], v[~over], p[~over]
                v = trie.step(v, flat[begin[w] + p])
                w, v, p = w[v >= 0], v[v >= 0], p[v >= 0] + 1
        q, node, here = q[more], node[more], here[more]
        node = trie.step(node, here)
        q, node, at = q[node >= 0], node[node >= 0], at + 1
    both = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_k)]), axis=1)
    return both[0], both[1]


CELL = ["side", "key", "shard", "block"]
PARTIAL = "word string, n long, near long, best_n long, best string"


def _walked(rows: pa.Table) -> pa.RecordBatch:
    """The partial results of whole cells: columns CELL, role (1: entry, 2: word that walks, 3: both), word, n."""
    cell = np.zeros(len(rows), int)
    for c in CELL:
        x = rows.column(c).combine_chunks()
        cell[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    cell = np.cumsum(cell)
    words, n, role = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("role").to_numpy()
    back = rows.column("side").to_numpy() == 1
    # Code points in the direction of the walk, behind the cell's number, which keeps cells apart.
    own = [[0x200 + c, *map(ord, reversed(w) if b else w)] for c, w, b in zip(cell.tolist(), words, back.tolist(), strict=True)]
    entries = sorted(np.flatnonzero(role & 1).tolist(), key=own.__getitem__)
    trie = Trie([own[k] for k in entries])
    entries_ = np.array(entries, int)
    rank = np.zeros(len(words), int)
    rank[sorted(entries, key=words.__getitem__)] = np.arange(len(entries))
    walkers = np.flatnonzero(role & 2)
    pairs = []
    for i in range(0, len(walkers), BLOCK):
        some = walkers[i : i + BLOCK]
        size = np.array([len(own[k]) for k in some.tolist()], int)
        flat = np.fromiter((c for k in some.tolist() for c in own[k]), np.int64, int(size.sum()))
        w, k = neighbours(trie, flat, np.cumsum(size) - size, size, 1 + np.where(back[some], TAIL, HEAD))
        w, k = some[w], entries_[k]
        # A pair that shares its beginning is found by it.
        new = [not b or words[x][:HEAD] != words[y][:HEAD] for x, y, b in zip(w.tolist(), k.tolist(), back[w].tolist(), strict=True)]
        pairs.append((w[new], k[new]))
    w, k = (np.concatenate([np.zeros(0, int), *[p[i] for p in pairs]]) for i in (0, 1))
    order = np.lexsort((rank[k], -n[k], w))
    w, k = w[order], k[order]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, int)
    near = np.zeros(len(words), int)
    np.add.at(near, w, 1)
    best = np.full(len(words), -1)
    best[w[first]] = k[first]
    best = best[walkers]
    some = pa.array(walkers)
    chosen = pa.array(np.maximum(best, 0), mask=best < 0)
    column = rows.column("word").combine_chunks()
    return pa.RecordBatch.from_arrays([column.take(some), rows.column("n").combine_chunks().take(some), pa.array(near[walkers]), rows.column("n").combine_chunks().take(chosen), column.take(chosen)], ["word", "n", "near", "best_n", "best"])


def partial_forms(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """For each word of words(word, n) and each shard that it meets: word, n, near (how many words), best_n and best (the most frequent of them)."""
    head, tail = F.struct(F.lit(0).alias("side"), F.substring("word", 1, HEAD).alias("key")), F.struct(F.lit(1).alias("side"), F.expr(f"right(word, {TAIL})").alias("key"))
    x = words.select("word", "n", F.explode(F.array(head, tail)).alias("c")).select("word", "n", "c.side", "c.key")
    large = x.groupBy("side", "key").agg(F.count("*").alias("size")).where(F.col("size") > shard)
    large = large.select("side", "key", F.ceil(F.col("size") / shard).cast("int").alias("cuts"))
    x = x.join(large, ["side", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    x = x.withColumn("own", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    cells = "concat(transform(sequence(0, cuts - 1), i -> named_struct('shard', own, 'block', i, 'role', if(i = own, 3, 1))), transform(filter(sequence(0, cuts - 1), i -> i <> own), i -> named_struct('shard', i, 'block', own, 'role', 2)))"
    x = x.withColumn("x", F.explode(F.expr(cells))).select("side", "key", "x.shard", "x.block", "x.role", "word", "n")
    x = x.repartition(parts(words.sparkSession), *CELL).sortWithinPartitions(*CELL)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < 2 * shard:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last = rows.slice(len(rows) - 1).to_pylist()[0]
            same = np.ones(len(rows), bool)
            for c in CELL:
                same &= pc.equal(rows.column(c), last[c]).to_numpy()
            cut = int(same.argmax())  # the last cell may go on
            if cut:
                yield _walked(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), len(rows) - cut
        if n:
            yield _walked(pa.Table.from_batches(held).combine_chunks())

    return x.mapInArrow(run, PARTIAL)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from forms(word, form): where following forms ends. Each round follows twice as many, and a form is RATIO times as frequent, so rounds are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        to = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if not step.where("moved").take(1):
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """A row for each word of the dictionary: word, n, n_near, form, form_n (null without a near word RATIO times as frequent), root."""
    spark = session(docs.sparkSession)
    words = written(dictionary(docs, id_col, text), "words")
    released(spark)
    found = partial_forms(words, shard).withColumn("m", F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    found = found.groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min("m").alias("b"))
    enough = -F.col("b.m") >= F.lit(RATIO) * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(enough, F.col("b.w")).alias("form"), F.when(enough, -F.col("b.m")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
