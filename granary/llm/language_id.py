"""Language identification by compression with a Zstandard raw-content dictionary for each language.

A language's dictionary is text of that language: of at most SAMPLE distinct texts (the documented bound of the sample: those whose hashes are
lowest), a piece of a quarter of the dictionary or the whole text where that is less, until they fill
DICTIONARY bytes. A text is encoded whole (in small letters, its words a space apart) with each dictionary, and the smallest output names the language. What
the runner-up needs more, in bits to a byte of text, is the margin; a margin below `least_margin` is rejected as `und`.

A null text, or one without a letter, is `und` with score 0. Equal sizes go to the language first in name. Repeated rows get
equal results; equal texts with one label are learned from once. Only the named columns are read, so others may have any name. Without any learnable row all texts are `und`. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import session

DICTIONARY, SAMPLE, LEVEL = 1 << 17, 300, 3
#: A label's hashes are ranked in so many groups first, so a frequent label's don't all meet in one task.
GROUPS = 16
#: ASCII other than small letters becomes a space.
PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What may be letters; numerals such as one half are among it.
WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """The whole text in small letters, with one space for what lies between words in ASCII."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in WORD.finditer(text) for c in m.group())


def learn(labelled: DataFrame, text: str = "text", label: str = "lang", size: int = DICTIONARY, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary for each non-null label; of at most `sample` texts of a label a piece of size / 4 characters at most comes to the driver. A long text's piece begins where its hash says."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # Ranks are given to hashes alone, so no text moves but the chosen ones'.
    hashes = rows.select("label", "h", F.pmod("h", F.lit(GROUPS)).alias("g")).distinct()
    lowest = hashes.withColumn("n", F.row_number().over(W.partitionBy("label", "g").orderBy("h"))).where(F.col("n") <= sample)
    chosen = lowest.select("label", "h", F.row_number().over(W.partitionBy("label").orderBy("h")).alias("n")).where(F.col("n") <= sample)
    piece = F.expr(f"substring(text, 1 + cast(pmod(h, greatest(length(text) - {size // 4}, 0) + 1) as int), {size // 4})")
    picked = rows.join(F.broadcast(chosen), ["label", "h"]).groupBy("label", "n").agg(F.min(piece).alias("piece"))  # `sample` rows a label
    held: dict[str, list[bytes]] = defaultdict(list)
    for r in picked.orderBy("label", "n").toLocalIterator():
        left = size - sum(len(x) + 1 for x in held[r["label"]])
        if left > 0:
            held[r["label"]].append(plain(r["piece"])[: min(left, size // 4)])
    return {k: b"\n".join(v) for k, v in sorted(held.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.names, self.by = list(dictionaries), []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and margin in bits a byte."""
        if text is None or not self.by or not has_letter(text):
            return "und", 0.0, 0.0
        data = plain(text)
        sizes = [len(c.compress(data)) for c in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 0.5, 0.0
        more = min(s for i, s in enumerate(sizes) if i != best) - sizes[best]
        return self.names[best], more / (more + 4.0), 8.0 * more / max(1, len(data))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text: str = "text", least_margin: float = 0.0) -> DataFrame:
    """id_col, lang_pred, score, margin, nearest (the language before rejection) for each row of docs."""
    session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        classify = Classifier(dictionaries)
        for batch in batches:
            got = [classify(t) for t in batch.column(1).to_pylist()]
            langs = ["und" if m < least_margin else lang for lang, _, m in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array([s for _, s, _ in got], pa.float64()), pa.array([m for _, _, m in got], pa.float64()), pa.array([x for x, _, _ in got], pa.string())], [id_col, "lang_pred", "score", "margin", "nearest"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, margin double, nearest string")
