"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Every K words make a gram; of each W grams in a
row the one with the smallest hash is kept (the leftmost of equal ones), on both sides. A span of WINDOW = W + K - 1 words
that a document shares with an item then always has a kept gram in common. The kept grams of documents meet those of
the benchmark in an equi-join; each hit is extended over the W windows that can hold its gram, comparing word hashes.

A benchmark's grams are broadcast only while its words number BROADCAST_WORDS at most; beyond, the join shuffles.
Items with fewer than WINDOW words are one window of their own length, found by its hash at every place of a document.
Null texts and texts without words have no words and hit nothing; items without words are skipped. Repeated documents give a row each
(equal doc_ids too); of items that share an id, any window counts for that id. An item without an id hits but isn't named.
Only doc_id and text are read, so other columns may have any name. An empty benchmark leaves every document clean; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, W_GRAMS = 5, 6
WINDOW = K + W_GRAMS - 1
BROADCAST_WORDS = 500_000
#: What parts words: ASCII other than digits and lower-case letters (capitals are lowered before).
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTS), "")


def word_hashes(text: F.Column) -> F.Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _kept(h: str = "_h") -> tuple[str, str]:
    """Expressions for the grams and for the places (from 0) of the grams that winnowing keeps of the word hashes in column h."""
    gram = f"transform(sequence(0, size({h}) - {K}), i -> xxhash64({', '.join(f'{h}[i + {j}]' for j in range(K))}))"
    least = f"transform(sequence(1, greatest(size(_g) - {W_GRAMS - 1}, 1)), i -> i - 2 + array_position(slice(_g, i, {W_GRAMS}), array_min(slice(_g, i, {W_GRAMS}))))"
    return gram, least


PRINT = "struct<_at:int,_gram:bigint,_len:int,_near:array<bigint>>"


def fingerprints(rows: DataFrame, short: list[int]) -> tuple[DataFrame, F.Column]:
    """rows with _h (word hashes) and what it takes for an array of (_at, _gram, _len, _near): each kept gram with its context, WINDOW + W_GRAMS - 1 hashes or fewer (_len WINDOW), and the windows of each of the short lengths."""
    gram, least = _kept()
    enough, none = F.size("_h") >= WINDOW, F.array().cast("array<bigint>")
    # Columns of their own: the grams and the kept places are read many times.
    rows = rows.withColumn("_g", F.when(enough, F.expr(gram)).otherwise(none))
    rows = rows.withColumn("_p", F.when(enough, F.array_distinct(F.expr(least))).otherwise(none))
    some = [F.expr(f"transform(_p, p -> named_struct('_at', cast(p as int), '_gram', _g[cast(p as int)], '_len', {WINDOW}, '_near', slice(_h, cast(greatest(p - {W_GRAMS - 1}, 0) as int) + 1, {WINDOW + W_GRAMS - 1})))")]
    for n in short:
        one = f"transform(sequence(0, size(_h) - {n}), i -> named_struct('_at', cast(i as int), '_gram', xxhash64({', '.join(f'_h[i + {j}]' for j in range(n))}), '_len', {n}, '_near', cast(null as array<bigint>)))"
        some.append(F.when(F.size("_h") >= n, F.expr(one)).otherwise(F.array().cast(f"array<{PRINT}>")))
    return rows, F.concat(*some)


def item_grams(benchmark: DataFrame, short: list[int]) -> DataFrame:
    """The items' kept grams (windows, where an item is shorter than WINDOW): item_id, _gram, _len, _iat, _inear."""
    b = benchmark.select("item_id", word_hashes(F.col("text")).alias("_h")).where(F.size("_h") > 0)
    rows, prints = fingerprints(b.withColumn("_own", F.least(F.size("_h"), F.lit(WINDOW))), short)
    own = rows.select("item_id", "_own", F.explode(prints).alias("_f")).where("_f._len = _own")
    # Beyond the first grams the place doesn't matter, so a repeated context of an item is one row.
    place = F.least(F.col("_f._at"), F.lit(W_GRAMS - 1)).alias("_iat")
    return own.select("item_id", "_f._gram", "_f._len", place, F.col("_f._near").alias("_inear")).distinct()


def _starts() -> F.Column:
    """The places where a window that holds the gram is equal on both sides."""
    a, b = f"least(_at, {W_GRAMS - 1})", f"least(_iat, {W_GRAMS - 1})"
    return F.expr(f"filter(transform(sequence(0, {W_GRAMS - 1}), o -> if(o <= {a} and o <= {b} and size(_near) >= {a} - o + {WINDOW} and size(_inear) >= {b} - o + {WINDOW} and slice(_near, {a} - o + 1, {WINDOW}) = slice(_inear, {b} - o + 1, {WINDOW}), _at - o, -1)), s -> s >= 0)")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted strings), hits (words hit, from 0), items_sha256, contaminated."""
    sizes = benchmark.select("item_id", F.size(words(F.col("text"))).alias("n")).where("n > 0")
    stats = sizes.agg(F.sum("n").alias("words"), F.collect_set(F.when(F.col("n") < WINDOW, F.col("n"))).alias("short")).first()  # at most WINDOW - 1 lengths
    short = sorted(stats["short"])
    near = F.broadcast if (stats["words"] or 0) <= BROADCAST_WORDS else (lambda x: x)
    # Rows are numbered and exploded in one pass, so a row's number is the same wherever it is used. A row's own entry has a gram that no item has: it keeps the row, and doesn't meet other rows' in a shuffle.
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), word_hashes(F.col("text")).alias("_h"))
    base = base.withColumn("n_words", F.size("_h"))  # here, as the exploded rows must not carry the hashes
    none = F.array(F.struct(F.lit(0).alias("_at"), F.xxhash64("_row").alias("_gram"), F.lit(0).alias("_len"), F.lit(None).cast("array<bigint>").alias("_near")))
    rows, own = fingerprints(base, short)
    prints = rows.select("doc_id", "_row", "n_words", F.explode(F.concat(none, own)).alias("_f")).select("doc_id", "_row", "n_words", "_f.*")
    items = near(item_grams(benchmark, short).withColumn("_item", F.lit(True)))
    joined = prints.join(items, ["_gram", "_len"], "left").where("_item is not null or _len = 0")  # false, not null, for what meets no item: the next filter is costly
    starts = F.when(F.col("_len") == WINDOW, _starts()).when(F.col("_len") > 0, F.array("_at")).otherwise(F.array().cast("array<int>"))
    found = joined.select("doc_id", "_row", "n_words", "item_id", "_len", starts.alias("_s")).where("size(_s) > 0 or _len = 0")
    spans = F.transform(F.col("_s"), lambda s: F.sequence(s, s + F.col("_len") - 1))
    per = found.groupBy("_row", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("_len") > 0, F.col("item_id").cast("string"))).alias("items"),
        F.collect_set(F.when(F.col("_len") > 0, F.flatten(spans))).alias("_spans"),
    )
    per = per.withColumn("items", F.sort_array("items")).withColumn("hits", F.array_sort(F.array_distinct(F.flatten("_spans"))))
    n_hit = F.size("hits").cast("long")
    return per.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0) -> DataFrame:
    """docs whose hit words are at most `most_share` of their words; columns are as they were, whatever their names. A document is judged by its id and text, so equal rows fare alike."""
    tagged = docs.select(F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).alias("key"), F.struct("*").alias("row"))
    judged = decontaminate(tagged.select(F.col("key").alias("doc_id"), "row.text"), benchmark)
    dirty = judged.where(F.col("n_hit") > F.lit(most_share) * F.col("n_words")).select(F.col("doc_id").alias("key")).distinct()
    return tagged.join(dirty, "key", "left_anti").select("row.*")
