"""The queries that apply this subpackage's operators to the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, phrases, sharding, substrings, token_counts, topk, toxicity, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.write(warc.resolve(pages, "page_id", "url", "html"))
    return warc.read(index).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents")).select("doc_id", "section", "begin", "end", "n_tokens", "doc_tokens")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    known = language_id.learn(docs.where(~F.coalesce(held_out, F.lit(True))))
    out = language_id.identify(docs, known)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin")


def held_out_labels() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def toxicity_model(spark: SparkSession, sf_dir: str):
    """Learned from the table `documents`, whatever rows are scored later."""
    return toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out_labels()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(held_out_labels(), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


_SQL = {
    "op8_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, l, s, array_to_string(w[s:s + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hit AS (SELECT r, s, dw.l, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.l = iw.l),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)""",
    "op9_mixing": r"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
  (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\N') || '|' || md5(coalesce(text, '')) || '|0'), 1, 12)) AS BIGINT) + 1.0::DOUBLE) / 281474976710657.0::DOUBLE AS u FROM documents),
k AS (SELECT d.doc_id, source, size, -ln(u) / CASE q.q WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS key FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (ARRAY[3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM k GROUP BY source),
c AS (SELECT *, 2 * source_size AS most, (2 * source_size)::DOUBLE / w AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 'inf'::DOUBLE) * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (epochs + CASE WHEN size > 0 AND upto - size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x""",
}

_SQL["op2_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN keep IS NULL OR page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000"""
_SQL["op10_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_SQL["op4_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, k, x, sum(CASE WHEN trim(x) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) - 1 AS p FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM d WHERE text IS NOT NULL)),
b AS (SELECT r, doc_id, p, x, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM l WHERE trim(x) <> '' WINDOW w AS (PARTITION BY r ORDER BY p)),
o AS (SELECT r, p, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id NULLS LAST, r, p) AS n FROM b WHERE x2 IS NOT NULL),
g AS (SELECT DISTINCT r, unnest([p, p + 1, p + 2]) AS p FROM o WHERE n > 1),
k AS (SELECT l.r, string_agg(x, chr(10) ORDER BY k) FILTER (WHERE trim(x) = '' OR g.p IS NULL) AS t, count(DISTINCT g.p) FILTER (WHERE trim(x) <> '') AS gone, count(*) FILTER (WHERE trim(x) <> '') AS n FROM l LEFT JOIN g ON l.r = g.r AND l.p = g.p GROUP BY l.r)
SELECT doc_id, CASE WHEN gone > 0 THEN coalesce(trim(t, chr(10)), '') ELSE text END AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(coalesce(gone, 0) AS INTEGER) AS n_removed FROM d LEFT JOIN k USING (r)"""

_SQL["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda v: v <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS n FROM g GROUP BY lang, k, g),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, n AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
u AS (SELECT lang, k, g, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.k, u.g, u.a, cut, l.n AS l, r.n AS r, CAST((1000000::HUGEINT * u.a * u.a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.g = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.g = array_to_string(w[cut + 1:u.k], ' ')),
b AS (SELECT lang, g, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, x, max(a) AS m FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS x FROM c WHERE k = 3) GROUP BY lang, x),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, t.n, score FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.x = b.g WHERE i.m IS NULL OR 100 * i.m < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""

_SQL["op12_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
l AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, r, p) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS q FROM l),
k AS (SELECT x.r, count(c.q) AS gone, string_agg(x, ' ' ORDER BY x.q) FILTER (WHERE c.q IS NULL) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) x LEFT JOIN c ON x.r = c.r AND x.q = c.q GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def oracle_sql() -> dict:
    return dict(_SQL)
