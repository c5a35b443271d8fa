"""Shared pieces: session settings, and hashing of words straight from Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.store import drop_written, new_path, released, written

__all__ = ["WHITE", "WordHasher", "drop_written", "free_name", "hashable", "marked", "maybe_in", "mix", "new_path", "parts", "released", "session", "text_chunks", "unit_hash", "written"]

#: Rows in an Arrow batch where the session leaves Spark's default, so a batch of long texts stays small.
BATCH_ROWS = 1000


def session(spark: SparkSession) -> SparkSession:
    """Sets what the operators need and the session leaves at Spark's defaults."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bits of a filter, in bitmaps of 32,768: one megabyte, whatever the data.
FILTER_BITMAPS = 256


def marked(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean `name`: false only where the key isn't among the keys; true else, and for a share of the others by chance. The filter has a fixed size and is broadcast; very many keys make it pass more, which costs time only."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITMAPS * 32768))
    bitmaps = keys.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("which")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits"))
    x = df.select(F.struct("*").alias("row"), at.alias("at"))
    x = x.join(F.broadcast(bitmaps), F.expr("at div 32768") == F.col("which"), "left")
    byte = F.expr("cast(conv(hex(substring(bits, cast(at % 32768 div 8 as int) + 1, 1)), 16, 10) as long)")
    return x.select("row.*", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1L, cast(at % 8 as int))")) != 0, F.lit(False)).alias(name))


def maybe_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df that `marked` marks: what is left to move before a join."""
    name = free_name(df.columns, "maybe")
    return marked(df, keys, key, name).where(F.col(name)).drop(name)


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashable(df: DataFrame) -> list[str]:
    """The columns whose types have a hash and an order."""
    return [c for c, t in df.dtypes if not any(x in t for x in ("map<", "variant"))]


def unit_hash(*cols) -> F.Column:
    """A number in (0, 1) that depends on the columns alone; the same in any engine that has md5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + F.lit(1.0)) / F.lit(281474976710657.0)


# ---- hashing of words ----

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of UTF-8 texts; words are runs of bytes that aren't separators. A-Z is lowered, unless `lower` is false."""

    def __init__(self, separators: bytes, lower: bool = True):
        self.is_sep = np.zeros(256, bool)
        self.is_sep[list(separators)] = True
        small = np.arange(256, dtype=np.uint64)
        if lower:
            small[65:91] += np.uint64(32)
        self.value = mix(small + np.uint64(1))
        self._powers(CHUNK)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
            self.inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE_INV, np.uint64)]))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data: the texts' bytes one after another; bounds: where each begins, and the end. Gives hashes, starts, ends, and for each text the number of its first word."""
        n = len(data)
        if n >= len(self.pow):
            self._powers(n)
        sep = self.is_sep[data]
        start = ~sep
        start[1:] &= sep[:-1]
        inner = bounds[(bounds > 0) & (bounds < n)]
        start[inner] = ~sep[inner]
        end = np.empty(n + 1, bool)
        if n:
            end[0], end[1:n], end[n] = False, ~sep[:-1] & sep[1:], not sep[-1]
            end[inner] = ~sep[inner - 1]
        else:
            end[:] = False
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[data] * self.pow[:n], out=total[1:])
            h = mix((total[e] - total[s]) * self.inv[s] + (e - s).astype(np.uint64) * M1)
        return h, s, e, np.searchsorted(s, bounds)


WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def text_chunks(column: pa.Array, most: int = CHUNK):
    """The texts of a column in pieces of about `most` bytes, a long text in a piece of its own: (first row, last row + 1, bytes, bounds). A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i])
        i = j
