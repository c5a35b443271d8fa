"""Profiles and vocabulary statistics over the documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import n_tokens
from granary.operators import profile, vocab
from granary.plans.catalog import CORPUS, TOKENS, corpus, query, table

COUNTS = TOKENS + ", counts AS (SELECT label, token, count(*) AS n FROM tokens GROUP BY ALL)"
FREQ = TOKENS + ", freq AS (SELECT token, count(*) AS f FROM tokens GROUP BY ALL)"


def _structure_sql() -> str:
    cols = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return " UNION ALL ".join(f"SELECT count(*) AS rows, '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS nulls, " + (f"count(*) FILTER (trim({c}) = '')" if t == "string" else "CAST(0 AS BIGINT)") + " AS blanks FROM documents" for c, t in cols.items())


@query("profile_structure", _structure_sql())
def _(spark, d):
    return profile.structure(table(spark, d, "documents"))


@query("label_distribution", f"""WITH {CORPUS}, c AS (SELECT split, label, count(*) AS n FROM corpus GROUP BY ALL)
SELECT split, label, n, round(n / sum(n) OVER w, 6) AS share, first_value(label) OVER (PARTITION BY split ORDER BY n DESC, label DESC) AS majority, round(max(n) OVER w / min(n) OVER w, 6) AS imbalance FROM c WINDOW w AS (PARTITION BY split)""")
def _(spark, d):
    return profile.label_distribution(corpus(spark, d))


@query("drift_tvd", f"""WITH {CORPUS}, s AS (SELECT DISTINCT split FROM corpus), l AS (SELECT DISTINCT label FROM corpus), c AS (SELECT split, label, count(*) AS n FROM corpus GROUP BY ALL),
p AS (SELECT s.split, l.label, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s.split) AS p FROM s CROSS JOIN l LEFT JOIN c ON c.split = s.split AND c.label = l.label)
SELECT a.split, round(0.5 * sum(abs(a.p - b.p)), 6) AS tvd, round(max(abs(a.p - b.p)), 6) AS max_diff FROM p a JOIN p b ON a.label = b.label AND b.split = 'train' WHERE a.split <> 'train' GROUP BY a.split""")
def _(spark, d):
    return profile.drift(corpus(spark, d), "train")


@query("char_profile", """WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT ch, n, CASE WHEN regexp_matches(ch, '^\\p{Ll}$') THEN 'lower' WHEN regexp_matches(ch, '^\\p{Lu}$') THEN 'upper' WHEN regexp_matches(ch, '^\\p{Nd}$') THEN 'digit' WHEN regexp_matches(ch, '^[\\x20\\x09-\\x0D]$') THEN 'space' WHEN regexp_matches(ch, '^[\\x21-\\x7E]$') THEN 'punct' ELSE 'other' END AS cls FROM n ORDER BY n DESC, ch LIMIT 20""".replace("\\\\", "\\"))
def _(spark, d):
    return profile.chars(table(spark, d, "documents")).orderBy(F.desc("n"), "ch").limit(20)


@query("char_classes", """WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch),
k AS (SELECT n, CASE WHEN regexp_matches(ch, '^\\p{Ll}$') THEN 'lower' WHEN regexp_matches(ch, '^\\p{Lu}$') THEN 'upper' WHEN regexp_matches(ch, '^\\p{Nd}$') THEN 'digit' WHEN regexp_matches(ch, '^[\\x20\\x09-\\x0D]$') THEN 'space' WHEN regexp_matches(ch, '^[\\x21-\\x7E]$') THEN 'punct' ELSE 'other' END AS cls FROM n)
SELECT cls, CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_chars FROM k GROUP BY cls""".replace("\\\\", "\\"))
def _(spark, d):
    return profile.char_classes(table(spark, d, "documents"))


#: Row tests: a pattern, a literal, a beginning, surrounding spaces.
@query("row_tests", r"""SELECT unnest(['digit', 'mail', 'starts_the', 'untrimmed', 'pipe']) AS test, unnest([count(*) FILTER (regexp_matches(text, '[0-9]')), count(*) FILTER (contains(text, '@')), count(*) FILTER (regexp_matches(text, '^The ')), count(*) FILTER (regexp_replace(text, '^[ \t\n]+|[ \t\n]+$', '', 'g') <> text), count(*) FILTER (contains(text, ' | '))]) AS n_rows FROM documents""")
def _(spark, d):
    t = F.col("text")
    return profile.rows_with(table(spark, d, "documents"), {"digit": t.rlike("[0-9]"), "mail": t.contains("@"), "starts_the": t.rlike("^The "), "untrimmed": F.regexp_replace(t, r"^[ \t\n]+|[ \t\n]+\z", "") != t, "pipe": t.contains(" | ")})


@query("regex_contains", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("[0-9]{3}-[0-9]{4}")).select("doc_id")


@query("literal_contains", "SELECT doc_id FROM documents WHERE contains(text, 'rights reserved')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("rights reserved")).select("doc_id")


@query("regex_match_prefix", "SELECT doc_id FROM documents WHERE regexp_matches(text, '^(The|An|In) ')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("^(The|An|In) ")).select("doc_id")


@query("trim_diff", r"SELECT doc_id, length(text) - length(trim(text)) AS trimmed FROM documents WHERE trim(text) <> text OR trim(text) = ''")
def _(spark, d):
    t = F.trim("text")
    return table(spark, d, "documents").where((t != F.col("text")) | (t == "")).select("doc_id", (F.length("text") - F.length(t)).cast("long").alias("trimmed"))


@query("filter_split", f"WITH {CORPUS} SELECT doc_id, label FROM corpus WHERE split = 'val'")
def _(spark, d):
    return corpus(spark, d).where("split = 'val'").select("doc_id", "label")


@query("row_id", f"WITH {CORPUS} SELECT doc_id, split || '_' || (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) AS row_id FROM corpus")
def _(spark, d):
    return corpus(spark, d).select("doc_id", F.concat_ws("_", "split", (F.row_number().over(W.partitionBy("split").orderBy("doc_id")) - 1).cast("string")).alias("row_id"))


@query("size_summary", rf"""WITH {CORPUS}, x AS (SELECT split, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM corpus)
SELECT split, CAST(min(chars) AS INTEGER) AS min_chars, median(chars)::DOUBLE AS median_chars, round(avg(chars), 6) AS mean_chars, CAST(max(chars) AS INTEGER) AS max_chars, CAST(min(words) AS INTEGER) AS min_words, median(words)::DOUBLE AS median_words, round(avg(words), 6) AS mean_words, CAST(max(words) AS INTEGER) AS max_words FROM x GROUP BY split""")
def _(spark, d):
    return profile.size_summary(corpus(spark, d), ["split"])


def _length_sql(value: str) -> str:
    p = ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{round(q * 100):02d}" for q in profile.PERCENTILES)
    row = f"count(v) AS n, CAST(min(v) AS INTEGER) AS min, CAST(max(v) AS INTEGER) AS max, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, {p}, round(CASE WHEN coalesce(stddev_samp(v), 0) > 0 THEN 3 * (avg(v) - median(v)) / stddev_samp(v) ELSE 0 END, 6) AS skew"
    return f"WITH {CORPUS}, x AS (SELECT label, {value} AS v FROM corpus) SELECT '*' AS cls, {row} FROM x UNION ALL SELECT label AS cls, {row} FROM x GROUP BY label"


@query("length_describe", _length_sql(r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"))
def _(spark, d):
    return profile.length_describe(corpus(spark, d))


@query("histogram_density", r"""WITH x AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::DOUBLE AS v FROM documents), b AS (SELECT CAST(least(floor((v - 0) / 25.0), 39) AS INTEGER) AS bin, count(*) AS n FROM x WHERE v BETWEEN 0 AND 1000 GROUP BY 1)
SELECT bin, n, round(n / (sum(n) OVER () * 25.0::DOUBLE), 8) AS density FROM b""")
def _(spark, d):
    return profile.histogram(table(spark, d, "documents"), n_tokens(F.col("text")), 0.0, 1000.0, 40)


RULES = {"id_known": "doc_id IS NOT NULL", "text_known": "text IS NOT NULL AND trim(text) <> ''", "lang_known": "lang IN ('en', 'de', 'fr', 'es')", "size_right": "n_chars = length(text)", "source_known": "source LIKE 'src%'"}


@query("contract_violations", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({c}, false)) AS n_bad FROM documents" for k, c in RULES.items()))
def _(spark, d):
    return profile.violations(table(spark, d, "documents"), {k: F.expr(c) for k, c in RULES.items()})


@query("vocab_counts", f"""WITH {TOKENS}, t AS (SELECT token, count(*) AS f, count(DISTINCT doc_id) AS df FROM tokens GROUP BY token), n AS (SELECT count(*) AS docs FROM corpus)
SELECT docs, CAST(sum(f) AS BIGINT) AS tokens, count(*) AS types, round(count(*) / sum(f), 6) AS ttr, count(*) FILTER (f = 1) AS hapax, count(*) FILTER (f = 2) AS dis, count(*) FILTER (df >= 0.01::DOUBLE * docs) AS common FROM t, n GROUP BY docs""")
def _(spark, d):
    return vocab.vocab_stats(corpus(spark, d))


@query("coverage_cumsum", f"""WITH {FREQ}, r AS (SELECT sum(f) OVER (ORDER BY f DESC, token ROWS UNBOUNDED PRECEDING) AS c, sum(f) OVER () AS total FROM freq), s AS (SELECT unnest([0.5, 0.8, 0.9, 0.95, 0.99])::DOUBLE AS share)
SELECT share, count(*) FILTER (c < share * total) + 1 AS types_needed FROM r, s GROUP BY share""")
def _(spark, d):
    return vocab.coverage(vocab.frequencies(corpus(spark, d)))


@query("zipf_fit", f"WITH {FREQ}, r AS (SELECT ln(row_number() OVER (ORDER BY f DESC, token)) AS x, ln(f) AS y FROM freq) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM r")
def _(spark, d):
    return vocab.zipf_fit(vocab.frequencies(corpus(spark, d)))


@query("freq_rank", f"WITH {FREQ} SELECT token, f, row_number() OVER (ORDER BY f DESC, token) AS rank, rank() OVER (ORDER BY f DESC) AS first_rank FROM freq")
def _(spark, d):
    return vocab.ranks(vocab.frequencies(corpus(spark, d)))


@query("first_rank_of_freq", f"WITH {FREQ} SELECT DISTINCT f, rank() OVER (ORDER BY f DESC) AS first_rank FROM freq")
def _(spark, d):
    x = vocab.by_frequency(vocab.frequencies(corpus(spark, d)))
    return x.select("f", (F.coalesce(F.sum("types").over(W.orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("first_rank"))


@query("most_common", f"WITH {FREQ} SELECT token, f FROM freq ORDER BY f DESC, token LIMIT 25")
def _(spark, d):
    return vocab.frequencies(corpus(spark, d)).orderBy(F.desc("f"), "token").limit(25)


@query("top_k_per_class", f"WITH {COUNTS} SELECT label, token, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, token) AS rank FROM counts) WHERE rank <= 15")
def _(spark, d):
    return vocab.top_k(vocab.token_counts(corpus(spark, d)), 15, ["label"], F.desc("n"), "token")


LOG_ODDS = COUNTS + """, cls AS (SELECT label, sum(n) AS n_cls FROM counts GROUP BY label), tok AS (SELECT token, sum(n) AS n_tok FROM counts GROUP BY token), al AS (SELECT sum(n) AS n_all FROM counts),
grid AS (SELECT cls.label, tok.token, coalesce(c.n, 0)::DOUBLE AS y, n_tok::DOUBLE AS a, n_all::DOUBLE AS a0, n_cls::DOUBLE AS ni, (n_all - n_cls)::DOUBLE AS nj FROM cls CROSS JOIN tok CROSS JOIN al LEFT JOIN counts c ON c.label = cls.label AND c.token = tok.token),
odds AS (SELECT label, token, CAST(y AS BIGINT) AS n, round((ln((y + a) / (ni + a0 - y - a)) - ln((a - y + a) / (nj + a0 - (a - y) - a))) / sqrt(1 / (y + a) + 1 / (a - y + a)), 6) AS z FROM grid)"""


@query("log_odds_z", f"WITH {LOG_ODDS} SELECT label, token, n, z, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, token) AS rank FROM odds) WHERE rank <= 15")
def _(spark, d):
    return vocab.top_k(vocab.log_odds(vocab.token_counts(corpus(spark, d))), 15, ["label"], F.desc("z"), "token")


@query("cue_lexicon", f"WITH {LOG_ODDS} SELECT DISTINCT token FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, token) AS rank FROM odds WHERE z >= 3) WHERE rank <= 150")
def _(spark, d):
    from granary.operators.outliers import cue_lexicon

    return cue_lexicon(vocab.token_counts(corpus(spark, d)))


@query("js_divergence", f"""WITH {COUNTS}, p AS (SELECT label, token, n / sum(n) OVER (PARTITION BY label) AS p FROM counts), l AS (SELECT DISTINCT label FROM counts), t AS (SELECT DISTINCT token FROM counts),
x AS (SELECT a.label AS a, b.label AS b, coalesce(pa.p, 0) AS p, coalesce(pb.p, 0) AS q FROM l a JOIN l b ON a.label < b.label CROSS JOIN t LEFT JOIN p pa ON pa.label = a.label AND pa.token = t.token LEFT JOIN p pb ON pb.label = b.label AND pb.token = t.token)
SELECT a, b, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS js FROM x GROUP BY a, b""")
def _(spark, d):
    return vocab.js_divergence(vocab.token_counts(corpus(spark, d)))


@query("vocab_jaccard", f"""WITH {COUNTS}, s AS (SELECT label, count(*) AS n FROM counts GROUP BY label), b AS (SELECT x.label AS a, y.label AS b, count(*) AS shared FROM counts x JOIN counts y ON x.token = y.token AND x.label < y.label GROUP BY ALL)
SELECT p.label AS a, q.label AS b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (p.n + q.n - coalesce(shared, 0)), 6) AS jaccard FROM s p JOIN s q ON p.label < q.label LEFT JOIN b ON b.a = p.label AND b.b = q.label""")
def _(spark, d):
    return vocab.vocab_jaccard(vocab.token_counts(corpus(spark, d)))


@query("type_spread", f"WITH {COUNTS}, t AS (SELECT token, count(*) AS n_classes, sum(n) AS f FROM counts GROUP BY token) SELECT n_classes, count(*) AS types, CAST(sum(f) AS BIGINT) AS tokens FROM t GROUP BY n_classes")
def _(spark, d):
    return vocab.type_spread(vocab.token_counts(corpus(spark, d)))


@query("multiset_subtract", f"WITH {COUNTS} SELECT label, token, CAST(rest AS BIGINT) AS rest FROM (SELECT label, token, sum(n) OVER (PARTITION BY token) - n AS rest FROM counts) WHERE rest > 0")
def _(spark, d):
    return vocab.rest_counts(vocab.token_counts(corpus(spark, d)))
