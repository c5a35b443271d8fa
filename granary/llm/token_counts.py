"""Token counts by offset-mapped attribution.

A document is encoded once, whole, with a public byte-level BPE vocabulary; each token's span follows from the lengths of its bytes. The
tokens are then interval-joined with the document's sections, which are spans of their own. A section is a line with its line end, or whatever
spans `sections` gives. A token within one section counts there. One that crosses a boundary is allocated by the
rule: `first` (the section of its first byte), `most` (the section that holds most of its bytes, the earlier of equal ones) or `split` (a share
to each section by bytes; counts are then fractions). Tokens outside every section count for section -1.

Section and token counts always add up to the document's. Null texts have no tokens and no sections; an empty text has one empty
section. Repeated rows get rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import session

#: Fixed value: how the vocabularies part a text before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's white space, and how long a run of it is encoded apart: the pattern's look-ahead steps back through a run one place at a time.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG = 1000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "most", "split")


def load(path: str = VOCABULARY) -> bytes:
    """The vocabulary's file, to be sent to the executors (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN, long: int = LONG):
        import tiktoken

        self.runs = re.compile(f"[{BLANK}]{{{max(long, 2)},}}") if pattern == PATTERN else None

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        """The text's tokens. Of a long run of white space the pattern takes all but the last character as one piece, or all of it at the end of the text: there the text can be cut."""
        ids, at = [], 0
        for run in self.runs.finditer(text) if self.runs else ():
            stop = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : stop].encode())
            at = stop
        return ids + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def ends(self, text: str) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        ids = self.encode(text)
        return np.cumsum(self.length[ids]) if ids else np.zeros(0, np.int64)


def line_spans(data: bytes) -> np.ndarray:
    """Begin and end of each line with its line end."""
    if not data:
        return np.zeros((1, 2), np.int64)
    cut = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    ends = cut if len(cut) and cut[-1] == len(data) else np.append(cut, len(data))
    return np.stack([np.append(0, ends[:-1]), ends], 1).astype(np.int64)


def allocate(ends: np.ndarray, spans: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens of each span, then of none; spans must be in order and apart."""
    starts = np.append(0, ends[:-1]).astype(np.int64)
    n = len(spans)
    out = np.zeros(n + 1)
    if not len(ends):
        return out
    if not n:
        out[0] = len(ends)
        return out
    # A token meets the spans from the first that ends after it begins to the last that begins before it ends.
    lo = np.searchsorted(spans[:, 1], starts, "right")
    hi = np.searchsorted(spans[:, 0], ends, "left") - 1
    one = (lo == hi) & (spans[np.minimum(lo, n - 1), 0] <= starts) & (spans[np.minimum(lo, n - 1), 1] >= ends)
    np.add.at(out, lo[one], 1)
    for t in np.flatnonzero(~one):
        a, b = int(starts[t]), int(ends[t])
        held = [(k, min(b, int(spans[k, 1])) - max(a, int(spans[k, 0]))) for k in range(lo[t], hi[t] + 1)]
        held = [(k, m) for k, m in held if m > 0]
        inside = sum(m for _, m in held)
        if rule == "split":
            for k, m in held:
                out[k] += m / (b - a)
            out[n] += (b - a - inside) / (b - a)
        elif rule == "most":
            k, m = max(held, key=lambda x: (x[1], -x[0]), default=(n, 0))
            out[k if m >= b - a - inside else n] += 1
        else:
            out[next((k for k, _ in held if spans[k, 0] <= a), n)] += 1
    return out


def count(docs: DataFrame, vocabulary: bytes | None = None, rule: str = "most", id_col: str = "doc_id", text: str = "text", sections=line_spans) -> DataFrame:
    """A row for each section of each of docs: id_col, section (from 0; -1: outside), begin and end in bytes, n_tokens, and doc_tokens, the document's."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = session(docs.sparkSession)
    vocabulary = load() if vocabulary is None else vocabulary
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            row, section, begin, end, tokens, whole = [], [], [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                if t is None:
                    continue
                ends = encoder.ends(t)
                spans = sections(t.encode())
                got = allocate(ends, spans, rule)
                k = len(spans) + (got[-1] > 0)
                row += [r] * k
                section += list(range(len(spans))) + [-1] * (k - len(spans))
                begin += spans[:, 0].tolist() + [None] * (k - len(spans))
                end += spans[:, 1].tolist() + [None] * (k - len(spans))
                tokens += got[:k].tolist()
                whole += [len(ends)] * k
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.float64()), pa.array(whole, pa.int64())], [id_col, "section", "begin", "end", "n_tokens", "doc_tokens"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, section int, begin long, end long, n_tokens double, doc_tokens long")
