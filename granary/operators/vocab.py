"""Vocabulary statistics over (label, token) counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.sources.store import numbered


def token_rows(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    return df.select(*keep, F.explode(tokens(F.col(text))).alias("token"))


def token_counts(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """(label, token, n): aggregated before the shuffle."""
    return token_rows(df, label, text=text).groupBy(label, "token").agg(F.count("*").alias("n"))


def vocab_stats(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens, types, type-token ratio, hapax and dis legomena, and types in at least 1 % of documents."""
    per_doc = token_rows(df, doc, text=text).groupBy(doc, "token").agg(F.count("*").alias("n"))
    types = per_doc.groupBy("token").agg(F.sum("n").alias("f"), F.count("*").alias("df"))
    docs = df.agg(F.count("*").alias("docs"))
    return types.crossJoin(F.broadcast(docs)).groupBy("docs").agg(
        F.sum("f").alias("tokens"), F.count("*").alias("types"), F.round(F.count("*") / F.sum("f"), 6).alias("ttr"),
        F.count_if(F.col("f") == 1).alias("hapax"), F.count_if(F.col("f") == 2).alias("dis"), F.count_if(F.col("df") >= 0.01 * F.col("docs")).alias("common"),
    )


def frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    return token_rows(df, text=text).groupBy("token").agg(F.count("*").alias("f"))


def by_frequency(freq: DataFrame) -> DataFrame:
    """How many types have each frequency: a table as small as the square root of the tokens, which is what ranks and coverage need."""
    return freq.groupBy("f").agg(F.count("*").alias("types"))


def coverage(freq: DataFrame, shares=(0.5, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """The least number of most frequent types that cover each share of the tokens."""
    w = W.orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, -1)
    x = by_frequency(freq).select("f", "types", F.coalesce(F.sum(F.col("f") * F.col("types")).over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("types").over(w), F.lit(0)).alias("ahead"), F.sum(F.col("f") * F.col("types")).over(W.partitionBy()).alias("total"))
    each = x.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    reach = F.col("share") * F.col("total")
    return each.where((F.col("before") < reach) & (F.col("before") + F.col("f") * F.col("types") >= reach)).select("share", (F.col("ahead") + F.ceil((reach - F.col("before")) / F.col("f"))).cast("long").alias("types_needed"))


def ranks(freq: DataFrame) -> DataFrame:
    """Each type's rank (ties by token) and the first rank of its frequency. Ranges of types are sorted apart and shifted by the counts before them, so the many types of one frequency share out."""
    freq = numbered(freq.select("token", "f"), [F.desc("f"), F.col("token")], "rank")
    return freq.join(F.broadcast(ahead_of(freq)), "f").select("token", "f", "rank", (F.col("ahead") + 1).alias("first_rank"))


def ahead_of(freq: DataFrame) -> DataFrame:
    """For each frequency how many types have a higher one."""
    w = W.orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, -1)
    return by_frequency(freq).select("f", "types", F.coalesce(F.sum("types").over(w), F.lit(0)).alias("ahead"))


def zipf_fit(freq: DataFrame) -> DataFrame:
    """Least squares of ln frequency on ln rank."""
    # Ranks are written out from the table of frequencies, a piece of each at a time: the types themselves don't matter.
    pieces = ahead_of(freq).select("f", "ahead", "types", F.explode(F.sequence(F.lit(0).cast("long"), F.col("types") - 1, F.lit(65_536).cast("long"))).alias("at"))
    each = pieces.select("f", F.explode(F.expr("sequence(ahead + at + 1, ahead + least(at + 65536, types))")).alias("rank"))
    x = each.select(F.log("rank").alias("x"), F.log("f").alias("y"))
    return x.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


def log_odds(counts: DataFrame, label: str = "label", prior: float = 1.0) -> DataFrame:
    """Weighted log-odds of each token in each class against the other classes, with an informative Dirichlet prior of `prior` times the corpus.

    counts: (label, token, n). The grid of tokens and classes is filled with zeros."""
    classes = counts.groupBy(label).agg(F.sum("n").alias("n_cls"))
    total = counts.agg(F.sum("n").alias("n_all"))
    words = counts.groupBy("token").agg(F.sum("n").alias("n_tok"), F.collect_list(F.struct(label, "n")).alias("by"))  # a class has one row in it
    grid = words.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(total))  # classes are few
    y = F.coalesce(F.get(F.filter("by", lambda x: x[label] == F.col(label)), F.lit(0))["n"], F.lit(0))
    grid = grid.withColumn("y", y).withColumn("a", prior * F.col("n_tok")).withColumn("a0", prior * F.col("n_all"))
    rest = F.col("n_tok") - F.col("y")
    n_rest = F.col("n_all") - F.col("n_cls")
    d = F.log((F.col("y") + F.col("a")) / (F.col("n_cls") + F.col("a0") - F.col("y") - F.col("a"))) - F.log((rest + F.col("a")) / (n_rest + F.col("a0") - rest - F.col("a")))
    var = 1 / (F.col("y") + F.col("a")) + 1 / (rest + F.col("a"))
    return grid.select(label, "token", F.col("y").alias("n"), F.round(d / F.sqrt(var), 6).alias("z"))


def top_k(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first k of each group in a total order; Spark prunes each partition to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def js_divergence(counts: DataFrame, label: str = "label") -> DataFrame:
    """Jensen-Shannon divergence in bits of each pair of classes over their union of tokens."""
    totals = counts.groupBy(label).agg(F.sum("n").alias("_all"))  # classes are few
    p = counts.join(F.broadcast(totals), label).withColumn("p", F.col("n") / F.col("_all"))
    # One row a token: pairs of classes are made from its (few) classes, absent ones counting 0.
    rows = p.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct(label, "p"))).alias("m"))
    names = counts.select(label).distinct()
    pairs = F.broadcast(names.select(F.col(label).alias("a")).crossJoin(names.select(F.col(label).alias("b"))).where("a < b"))
    half = lambda x, m: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    x = rows.crossJoin(pairs).select("a", "b", F.coalesce(F.col("m")[F.col("a")], F.lit(0.0)).alias("p"), F.coalesce(F.col("m")[F.col("b")], F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return x.where("p > 0 or q > 0").groupBy("a", "b").agg(F.round(F.sum(half(F.col("p"), m) + half(F.col("q"), m)), 6).alias("js"))


def vocab_jaccard(counts: DataFrame, label: str = "label") -> DataFrame:
    sizes = counts.groupBy(label).agg(F.count("*").alias("size"))
    both = counts.groupBy("token").agg(F.collect_set(label).alias("c")).select(F.explode(F.expr("flatten(transform(c, x -> transform(filter(c, y -> x < y), y -> named_struct('a', x, 'b', y))))")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    s = F.broadcast(sizes)
    x = s.select(F.col(label).alias("a"), F.col("size").alias("na")).crossJoin(s.select(F.col(label).alias("b"), F.col("size").alias("nb"))).where("a < b").join(both, ["a", "b"], "left").na.fill(0, ["shared"])
    return x.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def type_spread(counts: DataFrame, label: str = "label") -> DataFrame:
    """How many types occur in exactly k classes, and their tokens."""
    return counts.groupBy("token").agg(F.count("*").alias("n_classes"), F.sum("n").alias("f")).groupBy("n_classes").agg(F.count("*").alias("types"), F.sum("f").alias("tokens"))


def rest_counts(counts: DataFrame, label: str = "label") -> DataFrame:
    """For each class the token counts of all other classes that stay above 0."""
    return counts.withColumn("rest", F.sum("n").over(W.partitionBy("token")) - F.col("n")).where("rest > 0").select(label, "token", "rest")
