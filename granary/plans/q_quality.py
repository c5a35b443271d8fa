"""Duplicates, leakage, conflicts, cleaning, and outlier flags of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import nfkd
from granary.functions.text import squash
from granary.operators import outliers, profile, quality, vocab
from granary.plans.catalog import ASCII_LOW, ASCII_UP, CORPUS, corpus, query, table
from granary.plans.q_profile import LOG_ODDS

#: A second labelling by source parity gives conflicts, which languages alone hardly do.
CONFLICT = "corpus AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'c' END AS label, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)"


def thirds(spark, d):
    m = F.pmod("doc_id", F.lit(3))
    return corpus(spark, d).withColumn("label", F.when(m == 0, "a").when(m == 1, "b").otherwise("c"))


@query("dup_within", f"""WITH {CONFLICT}, g AS (SELECT split, text, count(*) AS n, count(DISTINCT label) AS k FROM corpus GROUP BY ALL)
SELECT split, CAST(sum(n) AS BIGINT) AS n_rows, count(text) AS distinct_texts, count(*) FILTER (n > 1 AND text IS NOT NULL) AS repeated_texts, CAST(sum(CASE WHEN n > 1 AND text IS NOT NULL THEN n - 1 ELSE 0 END) AS BIGINT) AS redundant_rows,
count(*) FILTER (n > 1 AND k = 1 AND text IS NOT NULL) AS one_label, count(*) FILTER (n > 1 AND k > 1 AND text IS NOT NULL) AS conflicting FROM g GROUP BY split""")
def _(spark, d):
    return quality.duplicates_within(thirds(spark, d))


def _overlap_sql(a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, count(*) AS shared_texts, count(*) FILTER (x.label = y.label) AS same_label, (SELECT count(*) FROM corpus WHERE split = '{b}' AND text IN (SELECT text FROM corpus WHERE split = '{a}')) AS rows_touched
FROM (SELECT text, arg_min(label, doc_id) AS label FROM corpus WHERE split = '{a}' GROUP BY text) x JOIN (SELECT text, arg_min(label, doc_id) AS label FROM corpus WHERE split = '{b}' GROUP BY text) y ON x.text = y.text"""


PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


@query("dup_cross", f"WITH {CONFLICT} " + " UNION ALL ".join(_overlap_sql(a, b) for a, b in PAIRS))
def _(spark, d):
    return profile.union_all([quality.overlap(thirds(spark, d), a, b) for a, b in PAIRS])


@query("join_label_agree", f"WITH {CONFLICT}, f AS (SELECT split, text, arg_min(label, doc_id) AS label FROM corpus GROUP BY ALL) SELECT x.label AS train_label, y.label AS test_label, count(*) AS n FROM f x JOIN f y ON x.text = y.text AND x.split = 'train' AND y.split = 'test' GROUP BY ALL")
def _(spark, d):
    df = thirds(spark, d)
    a, b = (quality.first_per_text(df.where(F.col("split") == s), "doc_id") for s in ("train", "test"))
    return a.select("text", F.col("label").alias("train_label")).join(b.select("text", F.col("label").alias("test_label")), "text").groupBy("train_label", "test_label").agg(F.count("*").alias("n"))


@query("semi_overlap", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE split = 'test' AND text IN (SELECT text FROM corpus WHERE split = 'train')")
def _(spark, d):
    df = corpus(spark, d)
    return df.where("split = 'test'").join(df.where("split = 'train'").select("text"), "text", "left_semi").select("doc_id")


@query("anti_leak", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE split = 'train' AND text NOT IN (SELECT text FROM corpus WHERE split <> 'train' AND text IS NOT NULL)")
def _(spark, d):
    df = corpus(spark, d)
    return df.where("split = 'train'").join(df.where("split <> 'train'").select("text"), "text", "left_anti").select("doc_id")


@query("contradiction", f"""WITH {CONFLICT}, k AS (SELECT text FROM corpus WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT label) > 1), m AS (SELECT text, max(n) AS best, sum(n) AS n FROM (SELECT text, label, count(*) AS n FROM corpus WHERE text IS NOT NULL GROUP BY ALL) GROUP BY text)
SELECT (SELECT count(*) FROM k) AS conflicting_texts, (SELECT count(DISTINCT text) FROM corpus WHERE split = 'test' AND text IN (SELECT text FROM k)) AS test_texts_contradicted, (SELECT round(sum(best) / sum(n), 6) FROM m) AS accuracy_ceiling""")
def _(spark, d):
    return quality.contradictions(thirds(spark, d), "test")


@query("pair_enrichment", f"""WITH {CONFLICT}, s AS (SELECT label, count(*) / (SELECT count(*) FROM corpus) AS p FROM corpus GROUP BY label), k AS (SELECT text, list_sort(list(DISTINCT label)) AS l FROM corpus WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT label) > 1),
o AS (SELECT l[1] AS a, l[2] AS b, count(*) AS n FROM k WHERE len(l) = 2 GROUP BY ALL), e AS (SELECT x.label AS a, y.label AS b, 2 * x.p * y.p / (1 - (SELECT sum(p * p) FROM s)) AS e FROM s x JOIN s y ON x.label < y.label)
SELECT e.a, e.b, coalesce(n, 0) AS observed, round(e, 6) AS expected_share, round(coalesce(n, 0) / (SELECT count(*) FROM k) / e, 6) AS enrichment FROM e LEFT JOIN o ON o.a = e.a AND o.b = e.b""")
def _(spark, d):
    return quality.pair_enrichment(thirds(spark, d))


CLEAN = CONFLICT + """, a AS (SELECT * FROM corpus WHERE split = 'train' AND text NOT IN (SELECT text FROM corpus WHERE split <> 'train' AND text IS NOT NULL)),
b AS (SELECT * FROM a WHERE text NOT IN (SELECT text FROM a GROUP BY text HAVING count(DISTINCT label) > 1)), c AS (SELECT text, min(doc_id) AS doc_id FROM b GROUP BY text)"""


@query("clean_policy", f"WITH {CLEAN} SELECT doc_id FROM c")
def _(spark, d):
    return quality.clean(thirds(spark, d))[0].select("doc_id")


@query("clean_policy_counts", f"WITH {CLEAN} SELECT t AS before, t - na AS leakage, na - nb AS conflicting, nb - nc AS redundant, nc AS after FROM (SELECT count(*) AS t FROM corpus WHERE split = 'train'), (SELECT count(*) AS na FROM a), (SELECT count(*) AS nb FROM b), (SELECT count(*) AS nc FROM c)")
def _(spark, d):
    return quality.clean(thirds(spark, d))[1]


@query("keep_first", f"WITH {CORPUS} SELECT min(doc_id) AS doc_id FROM corpus GROUP BY text")
def _(spark, d):
    return quality.first_per_text(corpus(spark, d), "doc_id").select("doc_id")


@query("conflict_elsewhere", f"WITH {CONFLICT} SELECT DISTINCT t.doc_id FROM corpus t JOIN corpus r ON t.text = r.text AND t.label <> r.label AND r.split = 'train' WHERE t.split = 'test'")
def _(spark, d):
    df = thirds(spark, d)
    return quality.conflict_elsewhere(df.where("split = 'test'"), df.where("split = 'train'")).select("doc_id")


SQUASH = rf"trim(regexp_replace(regexp_replace(translate(text, '{ASCII_UP}', '{ASCII_LOW}'), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"


@query("normalize_noop", f"SELECT count(*) AS n_rows, count(*) FILTER ({SQUASH} <> text) AS changed FROM documents")
def _(spark, d):
    return quality.changed_by_normalizing(table(spark, d, "documents"))


@query("squashed_duplicates", f"SELECT md5({SQUASH}) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "documents").select(F.md5(squash(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


@query("normalize_nfkd")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", nfkd.ascii_form(F.col("text")).alias("plain"))


@query("benchmark_containment", "SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(spark, d):
    return quality.contained(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id").distinct()


@query("intersect", f"WITH {CORPUS} SELECT md5(text) AS h FROM (SELECT text FROM corpus WHERE split = 'train' INTERSECT SELECT text FROM corpus WHERE split = 'test')")
def _(spark, d):
    df = corpus(spark, d)
    return df.where("split = 'train'").select("text").intersect(df.where("split = 'test'").select("text")).select(F.md5("text").alias("h"))


@query("union_all", f"WITH {CORPUS} SELECT doc_id, label FROM corpus WHERE split = 'val' UNION ALL SELECT doc_id, label FROM corpus WHERE split = 'test'")
def _(spark, d):
    df = corpus(spark, d)
    return profile.union_all([df.where(F.col("split") == s).select("doc_id", "label") for s in ("val", "test")])


@query("union_distinct", r"SELECT source AS s FROM documents UNION SELECT lang FROM documents")
def _(spark, d):
    df = table(spark, d, "documents")
    return df.select(F.col("source").alias("s")).union(df.select("lang")).distinct()


# ---- outliers ----

TEMPLATE = "the|der|le|la"
FLAGS = LOG_ODDS + rf""", cues AS (SELECT DISTINCT token FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, token) AS rank FROM odds WHERE z >= 3) WHERE rank <= 150), fr AS (SELECT token, count(*) AS f FROM tokens GROUP BY token),
sums AS (SELECT doc_id, count(*) AS n_words, count(cues.token) AS n_cues, count(*) FILTER (f <= 2) / count(*) AS rare FROM tokens JOIN fr USING (token) LEFT JOIN cues USING (token) GROUP BY doc_id),
docs AS (SELECT c.doc_id, c.label, coalesce(n_words, 0) AS n_words, coalesce(n_cues, 0) AS n_cues, coalesce(rare, 0) AS rare, NOT regexp_matches(text, '{TEMPLATE}') AS off FROM corpus c LEFT JOIN sums USING (doc_id)),
cut AS (SELECT quantile_cont(n_words, 0.25) AS q1, quantile_cont(n_words, 0.75) AS q3, quantile_cont(rare, 0.99) AS rc FROM docs),
flags AS (SELECT doc_id, label, CAST(n_words AS INTEGER) AS n_words, n_cues, round(rare, 6) AS rare_share, n_words <= 5 AS is_short, n_words >= q3 + 1.5 * (q3 - q1) AS is_long, off AS is_off_template, rare >= rc AS is_rare_heavy, n_cues = 0 AS is_cue_free FROM docs, cut),
flagged AS (SELECT *, is_short::INTEGER + is_long::INTEGER + is_off_template::INTEGER + is_rare_heavy::INTEGER + is_cue_free::INTEGER AS n_flags FROM flags)"""


def flagged(spark, d):
    return outliers.flags(corpus(spark, d), TEMPLATE)


@query("outlier_flags", f"WITH {FLAGS} SELECT * FROM flagged")
def _(spark, d):
    return flagged(spark, d)


@query("flag_overlap", f"WITH {FLAGS} SELECT count(*) FILTER (n_flags = 0) AS \"none\", count(*) FILTER (n_flags = 1) AS one, count(*) FILTER (n_flags >= 2) AS two_plus, count(*) FILTER (n_flags >= 3) AS three_plus FROM flagged")
def _(spark, d):
    return outliers.flag_overlap(flagged(spark, d))


@query("class_profile", f"WITH {CORPUS}, x AS (SELECT label, count(*) AS n, count(*) FILTER (length(text) < 300) AS n_in FROM corpus GROUP BY label) SELECT label, n_in, round(n_in / sum(n_in) OVER (), 6) AS share, round(n_in / sum(n_in) OVER () / (n / sum(n) OVER ()), 6) AS lift FROM x")
def _(spark, d):
    return outliers.class_profile(corpus(spark, d), F.length("text") < 300)


@query("bucket_coverage", f"WITH {FLAGS} SELECT CAST(CASE WHEN n_words <= 5 THEN 0 WHEN n_words <= 10 THEN 1 WHEN n_words <= 20 THEN 2 WHEN n_words <= 40 THEN 3 WHEN n_words <= 80 THEN 4 ELSE 5 END AS INTEGER) AS bucket, count(*) AS n, round(avg((n_cues > 0)::INTEGER), 6) AS with_cue, round(avg(n_cues), 6) AS mean_cues FROM flagged GROUP BY 1")
def _(spark, d):
    return outliers.bucket_coverage(flagged(spark, d))


@query("join_left_flags", f"WITH {FLAGS} SELECT c.doc_id, c.split, f.n_flags FROM corpus c LEFT JOIN flagged f ON c.doc_id = f.doc_id AND f.n_flags > 0")
def _(spark, d):
    return corpus(spark, d).select("doc_id", "split").join(flagged(spark, d).where("n_flags > 0").select("doc_id", "n_flags"), "doc_id", "left")


@query("shot_pool", f"WITH {FLAGS} SELECT c.doc_id, c.label FROM corpus c JOIN flagged f USING (doc_id) WHERE split = 'train' AND n_flags = 0 AND n_words <= 200")
def _(spark, d):
    return corpus(spark, d).where("split = 'train'").select("doc_id", "label").join(flagged(spark, d).where("n_flags = 0 and n_words <= 200").select("doc_id"), "doc_id")


@query("genre_split", f"WITH {CORPUS} SELECT label, regexp_matches(text, '(^| )(in|In|die|le|la) ') AS has_marker, regexp_matches(text, '(on|en)[.]') AS has_end, count(*) AS n FROM corpus GROUP BY ALL")
def _(spark, d):
    t = F.col("text")
    return corpus(spark, d).groupBy("label", t.rlike("(^| )(in|In|die|le|la) ").alias("has_marker"), t.rlike("(on|en)[.]").alias("has_end")).agg(F.count("*").alias("n"))


@query("tukey_fences", r"WITH x AS (SELECT n_chars AS v FROM documents), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x) SELECT q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_fence, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_fence FROM q")
def _(spark, d):
    return outliers.tukey(table(spark, d, "documents"), F.col("n_chars"))


MARKS = {"tag": "</?[a-z]+[^>]*>", "entity": "&[a-z]+;", "script": "<script", "href": "href=", "http": "https?://"}


@query("html_residue", " UNION ALL ".join(f"SELECT '{k}' AS mark, count(*) FILTER (regexp_matches(html, '{p}')) AS n_pages, CAST(sum(len(regexp_extract_all(html, '{p}'))) AS BIGINT) AS n_marks FROM pages" for k, p in MARKS.items()))
def _(spark, d):
    one = table(spark, d, "pages").agg(*[x for k, p in MARKS.items() for x in (F.count_if(F.col("html").rlike(p)).alias(f"p_{k}"), F.sum(F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")).alias(f"m_{k}"))])
    return one.selectExpr(f"stack({len(MARKS)}, " + ", ".join(f"'{k}', p_{k}, m_{k}" for k in MARKS) + ") AS (mark, n_pages, n_marks)")


@query("html_filter", "SELECT page_id, length(html) AS n_chars FROM pages WHERE regexp_matches(html, '<(script|style)[ >]')")
def _(spark, d):
    return table(spark, d, "pages").where(F.col("html").rlike("<(script|style)[ >]")).select("page_id", F.length("html").cast("long").alias("n_chars"))


@query("neg_filter", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z])(not|no|nie|nicht|ne|pas)([^A-Za-z]|$)')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(r"(^|[^A-Za-z])(not|no|nie|nicht|ne|pas)([^A-Za-z]|\z)")).select("doc_id")


@query("exclude_tokens", r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id FROM t WHERE NOT list_has_any(w, ['the', 'der', 'la', 'le'])")
def _(spark, d):
    from granary.functions.text import tokens

    return table(spark, d, "documents").where(~F.arrays_overlap(tokens(F.col("text")), F.array(*[F.lit(x) for x in ("the", "der", "la", "le")]))).select("doc_id")
