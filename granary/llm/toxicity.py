"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled rows: words that occur in toxic documents far more than chance allows, and stems
(beginnings of words) where no single word explains the hits. Its trie and the automaton of words within one edit are walked together and made
into one table of states by classes of bytes, so all words of a batch take a step at a time. Words and stems
of MIN_FUZZY letters or more match with one edit, a stem with its last letter in place. Variants that clean labelled documents use are no hits,
and a word or stem with more than COMMON_SHAPE of them takes no edits. Digits and
the signs *, @ and $ within a word are part of it, so that one of them may stand for a letter.

A hit counts 1, a misspelled one FUZZY; between quotation marks within WINDOW bytes on the same line it counts QUOTED of that. The logarithm of 1 +
the document's sum goes through a logistic function fitted on the labelled rows.

At most SAMPLE labelled rows are learned from, those whose ids hash lowest (the documented bound; texts that repeat an id count each, equal rows only add weight). Only doc_id and text are read, so other columns may have any name. A row without text or words scores as one without
hits. Labels may repeat: the largest counts. Without both classes among the labels every score is the share of toxic rows. Repeated rows get
equal results; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordHasher, session, text_chunks, written

SAMPLE, MIN_FUZZY, FUZZY, QUOTED, WINDOW = 10_000, 5, 0.8, 0.2, 80
CHANCE, SHARE, NEIGHBOURS, MIN_STEM, MAX_STEM = 1e-5, 0.02, 0.5, 3, 8
#: A term or stem with more such neighbours among clean words takes no edits.
COMMON_SHAPE = 2
#: ASCII other than letters, digits and the signs that stand for letters parts words; digits and signs at a word's ends aren't its own.
SIGNS = b"0123456789*@$"
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in SIGNS)
QUOTES = re.compile("|".join(["\"", "\u201c", "\u201d", "\u201e", "\u00ab", "\u00bb"]).encode())


# ---- the automaton ----

class Automaton:
    """The words within one edit of a lexicon's words, and those that begin with its stems or with what is within one edit of them, as a table of states."""

    def __init__(self, terms: list[str], stems: list[str], benign: set[str] = frozenset(), rigid: set[str] = frozenset()):
        """benign: words that are no misspellings; rigid: terms and stems that take no edits."""
        self.terms, self.stems, self.benign = sorted(set(terms)), sorted(set(stems)), set(benign)
        takes = lambda x: len(x) >= MIN_FUZZY and x not in rigid
        self.nodes: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]  # the term that ends at a node
        self.stem_at: list[bool] = [False]
        self.fuzzy_at: list[bool] = [False]  # a term that takes edits passes through
        for n, term in enumerate(self.terms):
            at = 0
            for b in term.encode():
                self.fuzzy_at[at] |= takes(term)
                at = self._child(at, b)
            self.ends[at] = n
            self.fuzzy_at[at] |= takes(term)
        self.fuzzy_stem = set()
        for stem in self.stems:
            at, fuzzy = 0, takes(stem)
            for b in stem.encode():
                self.fuzzy_at[at] |= fuzzy
                at = self._child(at, b)
            self.stem_at[at] = True
            self.fuzzy_at[at] |= fuzzy
            if fuzzy:
                self.fuzzy_stem.add(at)
        self.fuzzy_end = [takes(t) for t in self.terms]
        self._table()

    def _child(self, at: int, b: int) -> int:
        if b not in self.nodes[at]:
            self.nodes[at][b] = len(self.nodes)
            self.nodes.append({})
            self.ends.append(-1)
            self.stem_at.append(False)
            self.fuzzy_at.append(False)
        return self.nodes[at][b]

    # A walk is (node, edits, inside): inside, the rest of a changed or added character's bytes cost nothing. Node -1: past a stem, with as many edits.
    def _closed(self, walks: set) -> frozenset:
        """With the walks that leave out a character of the lexicon's."""
        out = set(walks)
        for node, edits, _ in walks:
            if node >= 0 and edits == 0:
                if self.stem_at[node]:
                    out.add((-1, 0, 0))
                if self.fuzzy_at[node]:
                    for b, child in self.nodes[node].items():
                        for last in self._past(b, child):
                            if self.fuzzy_at[last]:
                                out.add((last, 1, 0))
        return frozenset(out)

    def _past(self, b: int, child: int) -> list[int]:
        """The nodes after the character that begins with byte b."""
        ends = [child]
        for _ in range((b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)):
            ends = [y for x in ends for y in self.nodes[x].values()]
        return ends

    def _step(self, walks: frozenset, b: int | None) -> frozenset:
        """b None: any byte that the lexicon doesn't have, lead of a longer character or not."""
        out = set()
        tail = b is not None and 0x80 <= b < 0xC0
        for node, edits, inside in walks:
            if node < 0:
                out.add((node, edits, 0))
                continue
            if inside and tail:
                out.add((node, edits, 1))
                continue
            if b is not None and b in self.nodes[node]:
                child = self.nodes[node][b]
                if edits == 0 or self.fuzzy_at[child]:
                    out.add((child, edits, 0))
                if edits and child in self.fuzzy_stem:
                    out.add((-1, 1, 0))
            if edits == 0 and self.fuzzy_at[node] and not tail:
                out.add((node, 1, 1))  # an added character
                for c, child in self.nodes[node].items():
                    for last in self._past(c, child):
                        if self.fuzzy_at[last]:
                            out.add((last, 1, 1))  # another character
        return self._closed(out)

    def _table(self) -> None:
        used = sorted({b for node in self.nodes for b in node})
        self.cls = np.zeros(256, np.uint8)  # 0: bytes that the lexicon lacks; 1: the same, within a character
        self.cls[0x80:0xC0] = 1
        for i, b in enumerate(used):
            self.cls[b] = i + 2
        self.cls[65:91] = self.cls[97:123]  # capitals as small letters
        tail = next((b for b in range(0x80, 0xC0) if b not in used), 0x80)
        start = self._closed({(0, 0, 0)})
        ids, todo, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        for walks in todo:
            row = []
            for b in [None, tail, *used]:
                to = self._step(walks, b) if walks else frozenset()
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        #: What a word that ends in a state is: 0 nothing, 1 a lexicon word, 2 a word with a stem, 3 a misspelled word.
        self.kind = np.zeros(len(todo), np.int8)
        for i, walks in enumerate(todo):
            if any(n >= 0 and e == 0 and self.ends[n] >= 0 for n, e, _ in walks):
                self.kind[i] = 1
            elif any(n < 0 and e == 0 for n, e, _ in walks):
                self.kind[i] = 2
            elif any(n < 0 or (e == 1 and self.ends[n] >= 0 and self.fuzzy_end[self.ends[n]]) for n, e, _ in walks):
                self.kind[i] = 3

    def match(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and kinds of the words (from s to e in data) that match."""
        live, state, at = np.arange(len(s)), np.ones(len(s), np.int32), s.copy()
        hits, kinds = [], []
        while len(live):
            state = self.table[state, self.cls[data[at]]]
            at = at + 1
            over = at >= e[live]
            got = over & (self.kind[state] > 0)
            if got.any():
                hits.append(live[got])
                kinds.append(self.kind[state[got]])
            keep = ~over & (state > 0)
            live, state, at = live[keep], state[keep], at[keep]
        if not hits:
            return np.zeros(0, int), np.zeros(0, np.int8)
        order = np.argsort(n := np.concatenate(hits), kind="stable")
        return n[order], np.concatenate(kinds)[order]


class Marks:
    """A text's quotation marks and line ends, found once."""

    def __init__(self, text: bytes):
        spans = [m.span() for m in QUOTES.finditer(text)]
        self.begin, self.end, self.size = [a for a, _ in spans], [b for _, b in spans], len(text)
        self.lines = np.flatnonzero(np.frombuffer(text, np.uint8) == 10).tolist()

    def around(self, s: int, e: int) -> bool:
        """Whether the word from s to e lies between quotation marks on its line: an odd number of marks before it, the last within WINDOW bytes, and another within WINDOW bytes after."""
        line = bisect_left(self.lines, s)
        begin = self.lines[line - 1] + 1 if line else 0
        line = bisect_left(self.lines, e)
        end = self.lines[line] if line < len(self.lines) else self.size
        first, upto, after = bisect_left(self.begin, begin), bisect_right(self.end, s), bisect_left(self.begin, e)
        return (upto - first) % 2 == 1 and s - self.end[upto - 1] <= WINDOW and after < len(self.end) and self.end[after] <= min(e + WINDOW, end)


def quoted(text: bytes, s: int, e: int) -> bool:
    return Marks(text).around(s, e)


class Scanner:
    """Hits of the texts of a column: for each text [exact, stem, misspelled, of them quoted, weighted sum], and the misspelled words."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.words = automaton, WordHasher(SEPARATORS)
        self.sign = np.zeros(256, bool)
        self.sign[list(SIGNS)] = True

    def _trimmed(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words without signs at their ends; a word of signs alone keeps one byte."""
        s, e = s.copy(), e.copy()
        for ends, step, at in ((s, 1, lambda x: x), (e, -1, lambda x: x - 1)):
            live = np.flatnonzero(self.sign[data[at(ends)]] & (e - s > 1))
            while len(live):
                ends[live] += step
                live = live[self.sign[data[at(ends[live])]] & (e[live] - s[live] > 1)]
        return s, e

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, list[set[str]]]:
        out, variants = np.zeros((len(column), 5)), [set() for _ in range(len(column))]
        for i, _, data, bounds in text_chunks(column):
            _, s, e, first = self.words(data, bounds)
            s, e = self._trimmed(data, s, e)
            hits, kinds = self.automaton.match(data, s, e)
            doc = np.searchsorted(first, hits, "right") - 1
            texts: dict[int, bytes] = {}
            marks: dict[int, Marks] = {}
            for h, kind, d in zip(hits.tolist(), kinds.tolist(), doc.tolist(), strict=True):
                if d not in texts:
                    texts = {d: data[bounds[d] : bounds[d + 1]].tobytes()}
                    marks = {d: Marks(texts[d])}
                a, b = int(s[h] - bounds[d]), int(e[h] - bounds[d])
                if kind == 3:
                    word = texts[d][a:b].decode("utf-8", "replace").lower()
                    variants[i + d].add(word)
                    if word in self.automaton.benign:
                        continue
                q = marks[d].around(a, b)
                out[i + d, kind - 1] += 1
                out[i + d, 3] += q
                out[i + d, 4] += (FUZZY if kind == 3 else 1.0) * (QUOTED if q else 1.0)
        return out, variants


# ---- learning ----

def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems from sample(text, toxic), toxic 0 or 1. All that pass come to the driver: the sample bounds them.

    A word or stem must be in SHARE of the toxic documents, in more than chance allows, in next to no clean ones, and there
    between ever other neighbours: what is common only because a document has many near copies keeps its neighbours. Equal
    texts count once a label."""
    return lexicon_of(sample.distinct())


def lexicon_of(sample: DataFrame) -> tuple[list[str], list[str]]:
    """As learn_lexicon, of texts that differ within a label."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return [], []
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = sample.select("toxic", F.split(low, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+").alias("ws"))
    forms = f"concat(array(concat('w', w)), transform(if(length(w) > {MIN_STEM}, sequence({MIN_STEM}, least({MAX_STEM}, length(w) - 1)), array()), n -> concat('s', substring(w, 1, n))))"
    seen = split.select("toxic", F.explode(F.array_distinct("ws")).alias("w")).where("length(w) >= 3").select("toxic", F.explode(F.expr(forms)).alias("f"))
    least = max(2, math.ceil(math.log(CHANCE) / math.log(n1 / (n1 + n0))), math.ceil(SHARE * n1))
    count = [F.count(F.when(F.col("toxic") == 1, 1)).alias("a"), F.count(F.when(F.col("toxic") == 0, 1)).alias("b")]
    few = seen.groupBy("f").agg(*count).where((F.col("a") >= least) & (F.col("a") * n0 >= 50 * F.col("b") * n1))
    # All forms that pass are written: a cut by frequency would let one copied document take all places.
    few = written(few.select("f", "a"), "forms")
    near = split.where("toxic = 1").select(F.explode(F.expr("transform(sequence(0, size(ws) - 1), i -> named_struct('w', ws[i], 'c', xxhash64(get(ws, i - 1), get(ws, i + 1))))")).alias("x"))
    near = near.select(F.col("x.w").alias("w"), F.col("x.c").alias("c")).where("length(w) >= 3").select(F.explode(F.expr(forms)).alias("f"), "c")
    apart = near.join(few, "f").groupBy("f", "a").agg(F.count_distinct("c").alias("c")).where(F.col("c") >= F.greatest(F.lit(least), F.col("a") * NEIGHBOURS)).select("f", "a").collect()
    found = {r["f"]: r["a"] for r in apart}
    terms = {f[1:]: a for f, a in found.items() if f[0] == "w"}
    stems = {f[1:]: a for f, a in found.items() if f[0] == "s" and max((x for w, x in terms.items() if w.startswith(f[1:])), default=0) < 0.8 * a}
    # Of nested stems the longest that still has nearly all hits of the shortest.
    best: dict[str, str] = {}
    for stem in sorted(stems, key=lambda x: (len(x), x)):
        root = next((x for x in best if stem.startswith(x)), None)
        if root is None or stems[stem] >= 0.98 * stems[root]:
            best[root or stem] = stem
    chosen = sorted(best.values())
    # Terms with a stem stay: they take the edits that stems don't.
    return sorted(terms), chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a ridge on the slope; n: how often each row counts."""
    n = np.ones_like(x) if n is None else n
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        p = min(max(p, 1e-3), 1 - 1e-3)
        return 0.0, math.log(p / (1 - p))
    a = b = 0.0
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = z.T @ (n * (p - y)) + np.array([ridge * a, 1e-6 * b])
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def misspelled_by(form: str, stem: bool, words: list[str]) -> int:
    """How many of the words are the term or stem with an edit."""
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    automaton = Automaton([] if stem else [form], [form] if stem else [])
    return int((automaton.match(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1]), ends)[1] == 3).sum()) if data else 0


class Model:
    def __init__(self, automaton: Automaton, slope: float, intercept: float):
        self.automaton, self.slope, self.intercept = automaton, slope, intercept


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the rows of docs that labels (doc_id, toxic) marks."""
    spark = session(docs.sparkSession)
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = F.broadcast(ids.select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")))  # `sample` rows at most
    picked = written(docs.select("doc_id", "text").join(few, "doc_id").withColumn("h", F.xxhash64("text")), "labelled")
    # Repeated ids may have more texts than `sample`: the cut is by hashes, so that no task orders texts.
    keys = picked.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)
    rows = picked.join(F.broadcast(keys), ["doc_id", "h"]).groupBy("text", "toxic").agg(F.count("*").alias("n"))
    rows = written(rows, "sample")
    terms, stems = lexicon_of(rows.select("text", "toxic"))
    rough = Automaton(terms, stems)

    def scan(automaton):
        def run(batches):
            scanner = Scanner(automaton)
            for batch in batches:
                sums, variants = scanner(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(sums[:, 4], pa.float64()), pa.array([sorted(v) for v in variants], pa.list_(pa.string())), batch.column(1), batch.column(2)], ["x", "variants", "y", "n"])

        return rows.mapInArrow(run, "x double, variants array<string>, y int, n long")

    seen = scan(rough).where("y = 0").select(F.explode("variants").alias("w")).distinct().collect()
    benign = sorted(r["w"] for r in seen)
    rigid = {x for kind in (terms, stems) for x in kind if len(x) >= MIN_FUZZY and misspelled_by(x, kind is stems, benign) > COMMON_SHAPE}
    automaton = Automaton(terms, stems, set(benign), rigid)
    # The curve needs counts of rows by sum and label only.
    counts = scan(automaton).groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    x, y, n = (np.array([r[c] for r in counts], float) for c in ("x", "y", "n"))
    slope, intercept = fit(np.log1p(x), y, n=n)
    return Model(automaton, slope, intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, score, predicted, and hits: exact, stem, misspelled, quoted."""
    session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    automaton, slope, intercept = model.automaton, model.slope, model.intercept
    names = ["exact", "stem", "misspelled", "quoted"]

    def run(batches):
        scanner = Scanner(automaton)
        for batch in batches:
            sums, _ = scanner(batch.column(1))
            p = 1 / (1 + np.exp(-np.clip(slope * np.log1p(sums[:, 4]) + intercept, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *[pa.array(sums[:, i].astype(np.int64)) for i in range(4)]], [id_col, "score", "predicted", *names])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, " + ", ".join(f"{c} long" for c in names))


def clean_rows(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs that score below the threshold, columns as they were; each row is judged by its own text."""
    session(docs.sparkSession)
    automaton, slope, intercept = model.automaton, model.slope, model.intercept
    at = docs.columns.index("text")

    def run(batches):
        scanner = Scanner(automaton)
        for batch in batches:
            sums, _ = scanner(batch.column(at))
            p = 1 / (1 + np.exp(-np.clip(slope * np.log1p(sums[:, 4]) + intercept, -50, 50)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
