"""Line dedup by overlapping windows of three lines.

A text's lines (parted by \\n, blank ones left out) give a window for every LINES of them in a row, known by two 64-bit hashes. A
window that occurs more than once anywhere is kept where it occurs first, in the order of (doc_id, place); each later occurrence
covers its lines, covered places of a document are merged, and those lines go. Blank lines stay, but what removal leaves of a
text has no line ends at its ends.

Rows are numbered once and written with their numbers, so that windows and removal speak of the same rows however the input is
computed. First occurrences come from a partial aggregate for each window, so no task gathers the occurrences of a common one.
Rows without a repeated window are not moved. Documents with fewer than LINES lines have no window and stay as they are, as do null and
empty texts. Repeated rows are documents of their own; a null doc_id comes after all others. Other columns may have any name; those named
like a result column (n_lines, n_removed, removed) give way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import marked, maybe_in, session, written

LINES = 3
#: A window with more occurrences than HOT meets its first one in SALTS parts.
HOT, SALTS = 10_000, 64
RESULT = ("n_lines", "n_removed", "removed")


def windows(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """A row for each window of rows(number, doc, text): number, doc, place (of its first line among the non-blank ones, from 0), window (two hashes)."""
    x = rows.select("number", "doc", F.expr("filter(split(text, '\\n'), x -> trim(x) <> '')").alias("lines")).where(F.size("lines") >= lines)
    x = x.select("number", "doc", F.transform("lines", lambda v: F.xxhash64(v)).alias("a"), F.transform("lines", lambda v: F.xxhash64(v, F.lit(1))).alias("b"))
    window = f"transform(sequence(0, size(a) - {lines}), i -> named_struct('x', xxhash64(slice(a, i + 1, {lines})), 'y', xxhash64(slice(b, i + 1, {lines}))))"
    return x.select("number", "doc", F.posexplode(F.expr(window)).alias("place", "window"))


def without(text: str, places) -> str:
    """The text without the non-blank lines at these places."""
    gone, kept, n = set(places), [], 0
    for line in text.split("\n"):
        if line.strip(" "):
            n += 1
            if n - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept).strip("\n")


def dedup(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text as it is left, and n_lines (non-blank), n_removed, removed (their places, from 0)."""
    session(docs.sparkSession)

    @F.pandas_udf("string")
    def shortened(body: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([without(t, p) for t, p in zip(body, places, strict=True)], dtype=object)

    own = [c for c in docs.columns if c.lower() not in RESULT]
    rows = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*own).alias("row")), "numbered")
    slim = rows.select("number", F.col(f"row.`{id_col}`").alias("doc"), F.col(f"row.`{text}`").alias("text"))
    w = written(windows(slim, lines), "windows")
    order = F.struct(F.col("doc").isNull().alias("n"), F.col("doc").alias("d"), F.col("number").alias("r"), F.col("place").alias("a"))
    repeated = written(w.groupBy("window").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1"), "repeated")
    # A window that the filter takes for a hot one has a row for each salt on this side, whether it is hot or not.
    hot = repeated.where(F.col("n") > HOT)
    firsts = marked(repeated, hot, "window", "hot").select("window", "first", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("number", "place"), F.lit(SALTS)).cast("int")).otherwise(0)
    seen = marked(maybe_in(w, repeated, "window"), hot, "window", "hot").withColumn("salt", salt).drop("hot")
    later = seen.join(firsts.hint("merge"), ["window", "salt"]).where((F.col("number") != F.col("first.r")) | (F.col("place") != F.col("first.a")))
    gone = later.groupBy("number").agg(F.collect_set("place").alias("p"))
    gone = written(gone.select("number", F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda p: F.sequence(p, p + lines - 1))))).alias("removed")), "gone")

    body = F.col(f"row.`{text}`")
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""))).alias("n_lines")
    maybe = marked(rows, gone, "number", "maybe")
    none = F.array().cast("array<int>")
    untouched = maybe.where("not maybe").select("row.*", n_lines, F.lit(0).alias("n_removed"), none.alias("removed"))
    # What goes grows with the input, so it isn't broadcast at any size.
    met = maybe.where("maybe").join(gone.hint("merge"), "number", "left").withColumn("removed", F.coalesce("removed", none))
    left = F.when(F.size("removed") > 0, shortened(F.coalesce(body, F.lit("")), "removed")).otherwise(body)
    cols = [left.alias(c) if c == text else F.col(f"row.`{c}`") for c in own]
    return untouched.unionByName(met.select(*cols, n_lines, F.size("removed").alias("n_removed"), "removed"))
