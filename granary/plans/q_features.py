"""TF-IDF of the documents, trips and customers made from the other tables, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import cluster, features
from granary.operators.quantiles import quantiles
from granary.plans.catalog import TOKENS, corpus, query, table
from granary.sources.store import written

BIGRAMS = TOKENS + r""", w AS (SELECT doc_id, split, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM corpus),
terms AS (SELECT doc_id, split, token AS term FROM tokens UNION ALL SELECT doc_id, split, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)"""
TF = "tf AS (SELECT doc_id, split, term, count(*) AS tf FROM {src} GROUP BY ALL), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus WHERE split = 'train')) / (1 + count(*))) + 1 AS idf FROM tf WHERE split = 'train' GROUP BY term HAVING count(*) >= 2), u AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS u FROM tf JOIN idf USING (term) WHERE split = 'val'), w2 AS (SELECT doc_id, term, u / sqrt(sum(u * u) OVER (PARTITION BY doc_id)) AS w FROM u)"
UNI = TOKENS + ", ts AS (SELECT doc_id, split, token AS term FROM tokens), " + TF.format(src="ts")
BI = BIGRAMS + ", " + TF.format(src="terms")


def weighted(spark, d, bigrams):
    df = corpus(spark, d)
    idf = written(features.idf(df.where("split = 'train'"), bigrams=bigrams), "idf")  # its size decides how it meets the terms
    val = df.where("split = 'val'")
    return val, features.tfidf(val, idf, bigrams=bigrams), idf


@query("tfidf", f"WITH {UNI} SELECT doc_id, term, round(w, 6) AS w FROM w2")
def _(spark, d):
    return weighted(spark, d, False)[1].select("doc_id", "term", F.round("w", 6).alias("w"))


@query("tfidf_bigrams", f"WITH {BI} SELECT doc_id, term, round(w, 6) AS w FROM w2")
def _(spark, d):
    return weighted(spark, d, True)[1].select("doc_id", "term", F.round("w", 6).alias("w"))


@query("tfidf_stats", f"WITH {UNI}, k AS (SELECT (SELECT count(*) FROM idf) AS vocabulary, (SELECT count(*) FROM corpus WHERE split = 'val') AS rows, count(*) AS nnz, count(DISTINCT doc_id) AS wt FROM w2) SELECT vocabulary, rows, nnz, round(nnz / (rows * vocabulary), 8) AS density, round(nnz / rows, 6) AS nnz_per_row, rows - wt AS empty_rows FROM k")
def _(spark, d):
    return features.tfidf_stats(*weighted(spark, d, False))


# ---- trips ----

TRIP = "event_id, user_id, ts AS started, 40.50 + (event_id * 37 % 500) / 1000.0 AS lat1, -74.20 + (event_id * 53 % 550) / 1000.0 AS lon1, 40.50 + (event_id * 71 % 500) / 1000.0 AS lat2, -74.20 + (event_id * 89 % 550) / 1000.0 AS lon2, CAST(event_id % 8 AS INTEGER) AS riders, CAST(1 + user_id % 2 AS INTEGER) AS vendor, CAST(30 + event_id * 17 % 9000 AS DOUBLE) AS seconds"
BOX = "lon1 BETWEEN -74.15 AND -73.70 AND lon2 BETWEEN -74.15 AND -73.70 AND lat1 BETWEEN 40.55 AND 40.95 AND lat2 BETWEEN 40.55 AND 40.95 AND riders BETWEEN 1 AND 6 AND started IS NOT NULL"
TRIPS = f"trips AS (SELECT event_id, user_id, started, lat1::DOUBLE AS lat1, lon1::DOUBLE AS lon1, lat2::DOUBLE AS lat2, lon2::DOUBLE AS lon2, riders, vendor, seconds FROM (SELECT {TRIP} FROM events)), ok AS (SELECT * FROM trips WHERE {BOX} AND seconds BETWEEN 60 AND 7200)"


def _hav(a, b, c, e):
    return f"(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))))"


FEATS = TRIPS + f""", f1 AS (SELECT *, {_hav('lat1', 'lon1', 'lat2', 'lon2')} AS distance_km, {_hav('lat1', 'lon1', 'lat2', 'lon1')} + {_hav('lat1', 'lon1', 'lat1', 'lon2')} AS manhattan_km,
atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))) AS br, hour(started) + minute(started) / 60 AS hour, (isodow(started) - 1) AS dow FROM ok),
feats AS (SELECT *, sin(br) AS bearing_sin, cos(br) AS bearing_cos, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos, CAST(dow >= 5 AS INTEGER) AS is_weekend, CAST(hour BETWEEN 7 AND 10 OR hour BETWEEN 16 AND 19 AS INTEGER) AS is_rush_hour FROM f1)"""


def trips(spark, d):
    x = table(spark, d, "events").selectExpr(*[e.strip() for e in TRIP.split(", ")])
    return x.select(*[F.col(c).cast("double").alias(c) if c in ("lat1", "lon1", "lat2", "lon2") else c for c in x.columns])


def good_trips(spark, d):
    return trips(spark, d).where(features.trip_ok(F.col("seconds")))


@query("between_bbox", f"WITH {TRIPS} SELECT event_id FROM ok")
def _(spark, d):
    return good_trips(spark, d).select("event_id")


@query("api_bounds", f"WITH {TRIPS} SELECT event_id, coalesce({BOX}, false) AS valid FROM trips")
def _(spark, d):
    return trips(spark, d).select("event_id", F.coalesce(features.trip_ok(), F.lit(False)).alias("valid"))


SHOWN = ["distance_km", "manhattan_km", "bearing_sin", "bearing_cos", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]


@query("trip_features", f"WITH {FEATS} SELECT event_id, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in SHOWN)}, is_weekend, is_rush_hour FROM feats")
def _(spark, d):
    x = features.trip_features(good_trips(spark, d))
    return x.select("event_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in SHOWN], "is_weekend", "is_rush_hour")


@query("trip_fare", f"WITH {FEATS}, s AS (SELECT *, greatest(60, least(7200, floor(seconds / 3 + 0.5))) AS s FROM feats) SELECT event_id, CAST(s AS BIGINT) AS duration_seconds, round(3 + distance_km * 1.85::DOUBLE + s / 60 * 0.48::DOUBLE + CASE WHEN is_rush_hour = 1 THEN 2.5::DOUBLE ELSE 0 END, 6) AS fare_usd, CASE WHEN is_rush_hour = 1 THEN 'Heavy' WHEN hour BETWEEN 7 AND 21 THEN 'Moderate' ELSE 'Light' END AS traffic_band FROM s")
def _(spark, d):
    x = features.fare(features.trip_features(good_trips(spark, d)), F.col("seconds") / 3)
    return x.select("event_id", "duration_seconds", F.round("fare_usd", 6).alias("fare_usd"), "traffic_band")


@query("tenure_days", "WITH r AS (SELECT max(o_orderdate)::DATE + 1 AS r FROM orders) SELECT o_orderkey, CAST(date_diff('day', o_orderdate::DATE, r) AS INTEGER) AS days, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders, r")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    ref = o.agg(F.date_add(F.max("day"), 1).alias("r"))
    return o.crossJoin(F.broadcast(ref)).select("o_orderkey", F.datediff("r", "day").alias("days"), F.weekday("day").alias("weekday"))


# ---- customers ----

CUSTOMER = """c0 AS (SELECT c_custkey AS id, CAST(1900 + c_custkey % 120 AS INTEGER) AS birth_year, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS income, CAST(c_custkey % 3 AS INTEGER) AS kids, CAST(c_custkey % 2 AS INTEGER) AS teens, coalesce(o.spend, 0) AS s1, o.n, o.joined FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS spend, count(*) AS n, min(o_orderdate)::DATE AS joined FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey),
cf AS (SELECT id, CAST(2024 - birth_year AS DOUBLE) AS age, income, CAST(date_diff('day', joined, (SELECT max(joined) + 1 FROM c0)) AS DOUBLE) AS customer_tenure_days, CAST(kids + teens AS DOUBLE) AS children, s1 + 10.0::DOUBLE AS total_spend, CAST(n + id % 4 + id % 5 AS DOUBLE) AS total_purchases, (s1 + 10.0::DOUBLE) / greatest(n + id % 4 + id % 5, 1) AS average_basket, CAST(id % 2 + id % 3 AS DOUBLE) AS campaign_acceptance, CAST(n / greatest(id % 7, 1) AS DOUBLE) AS web_conversion FROM c0),
cust AS (SELECT * FROM cf WHERE age BETWEEN 18 AND 100 AND total_spend >= 0)"""
NINE = ["age", "income", "customer_tenure_days", "children", "total_spend", "total_purchases", "average_basket", "campaign_acceptance", "web_conversion"]


def customers(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s1"), F.count("*").cast("int").alias("web"), F.to_date(F.min("o_orderdate")).alias("joined"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("c_custkey")
    raw = c.select(
        k.alias("id"), (1900 + k % 120).cast("int").alias("birth_year"), "joined", F.when(k % 11 == 0, None).otherwise(F.col("c_acctbal")).alias("income"), (k % 3).cast("int").alias("kids"), (k % 2).cast("int").alias("teens"),
        F.array("s1", F.lit(10.0)).alias("spend"), "web", (k % 4).cast("int").alias("catalog"), (k % 5).cast("int").alias("store"), (k % 7).cast("int").alias("visits"), F.array(k % 2, k % 3).alias("accepted"),
    )
    return features.customer_features(raw, "2024-06-01")


@query("customer_features", f"WITH {CUSTOMER} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in NINE)} FROM cust")
def _(spark, d):
    return customers(spark, d).select("id", *[F.round(c, 6).alias(c) for c in NINE])


@query("age_valid", f"WITH {CUSTOMER} SELECT count(*) AS kept, (SELECT count(*) FROM cf) AS before FROM cust")
def _(spark, d):
    before = table(spark, d, "orders").select("o_custkey").distinct().join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("before"))
    return customers(spark, d).agg(F.count("*").alias("kept")).crossJoin(before)


IMPUTED = CUSTOMER + f", im AS (SELECT id, {', '.join(f'coalesce({c}, (SELECT median({c}) FROM cust)) AS {c}' for c in NINE)} FROM cust)"


@query("impute_scale", f"WITH {IMPUTED} SELECT id, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}' for c in NINE)} FROM im")
def _(spark, d):
    return features.impute_scale(customers(spark, d), NINE).select("id", *[F.round(c, 6).alias(c) for c in NINE])


def clustered(spark, d):
    return customers(spark, d).withColumn("cluster", F.pmod("id", F.lit(5)))


PROFILE = CUSTOMER + f", prof AS (SELECT id % 5 AS cluster, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in NINE)} FROM cust GROUP BY 1)"


@query("persona_profile", f"WITH {PROFILE} SELECT *, round(n / sum(n) OVER (), 6) AS share FROM prof")
def _(spark, d):
    return cluster.persona_profile(clustered(spark, d), NINE)


@query("avg_rank", f"WITH {PROFILE} SELECT cluster, rank() OVER (ORDER BY total_spend) + (count(*) OVER (PARTITION BY total_spend) - 1) / 2 + rank() OVER (ORDER BY campaign_acceptance) + (count(*) OVER (PARTITION BY campaign_acceptance) - 1) / 2 AS score FROM prof")
def _(spark, d):
    from granary.operators.evaluate import average_ranks

    p = cluster.persona_profile(clustered(spark, d), NINE)
    return p.select("cluster", (average_ranks(p, "total_spend") + average_ranks(p, "campaign_acceptance")).alias("score"))


@query("greedy_persona", f"""WITH {PROFILE}, v AS (SELECT *, rank() OVER (ORDER BY total_spend) + (count(*) OVER (PARTITION BY total_spend) - 1) / 2 + rank() OVER (ORDER BY campaign_acceptance) + (count(*) OVER (PARTITION BY campaign_acceptance) - 1) / 2 AS vip FROM prof),
p1 AS (SELECT cluster FROM v ORDER BY vip DESC, cluster LIMIT 1), p2 AS (SELECT cluster FROM v WHERE cluster NOT IN (FROM p1) ORDER BY web_conversion DESC, cluster LIMIT 1), p3 AS (SELECT cluster FROM v WHERE cluster NOT IN (FROM p1 UNION FROM p2) ORDER BY children DESC, cluster LIMIT 1), p4 AS (SELECT cluster FROM v WHERE cluster NOT IN (FROM p1 UNION FROM p2 UNION FROM p3) ORDER BY total_spend DESC, cluster LIMIT 1)
SELECT cluster, CASE WHEN cluster IN (FROM p1) THEN 'VIP Champions' WHEN cluster IN (FROM p2) THEN 'Digital Enthusiasts' WHEN cluster IN (FROM p3) THEN 'Family Builders' WHEN cluster IN (FROM p4) THEN 'Value Seekers' ELSE 'Emerging Customers' END AS persona FROM v""")
def _(spark, d):
    return cluster.personas(cluster.persona_profile(clustered(spark, d), NINE))


CENTRES = [[30.0, 2000.0], [50.0, 5000.0], [70.0, 8000.0]]


DISTANCES = ", ".join(f"sqrt(pow(age - {a}::DOUBLE, 2) + pow(income - {b}::DOUBLE, 2)) AS d{i}" for i, (a, b) in enumerate(CENTRES))


@query("segment_predict", f"WITH {IMPUTED}, ds AS (SELECT id, {DISTANCES} FROM im) SELECT id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, round(1 / (exp(least(d0, d1, d2) - d0) + exp(least(d0, d1, d2) - d1) + exp(least(d0, d1, d2) - d2)), 6) AS confidence FROM ds")
def _(spark, d):
    c = customers(spark, d)
    med = quantiles(c, {"m": F.col("income")}, [0.5]).select(F.col("m")[0].alias("m"))
    x = c.crossJoin(F.broadcast(med)).select("id", "age", F.coalesce("income", "m").alias("income"))
    return cluster.assign(x, CENTRES, ["age", "income"]).select("id", "cluster", "confidence")


# ---- clusters of labelled rows ----

GROUPS = "g AS (SELECT doc_id, source AS cluster, lang AS label FROM documents)"


@query("contingency", f"WITH {GROUPS} SELECT cluster, label, count(*) AS n FROM g GROUP BY ALL")
def _(spark, d):
    return cluster.contingency(table(spark, d, "documents").selectExpr("source AS cluster", "lang AS label"), "cluster", "label")


EXTERNAL = GROUPS + """, c AS (SELECT cluster, label, count(*) AS n FROM g GROUP BY ALL), a AS (SELECT cluster, sum(n) AS x FROM c GROUP BY cluster), b AS (SELECT label, sum(n) AS x FROM c GROUP BY label), t AS (SELECT sum(n) AS n FROM c),
k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sc, (SELECT sum(x * (x - 1) / 2) FROM a) AS sa, (SELECT sum(x * (x - 1) / 2) FROM b) AS sb, n * (n - 1) / 2 AS s, (SELECT -sum(x / n * ln(x / n)) FROM a) AS ha, (SELECT -sum(x / n * ln(x / n)) FROM b) AS hb, (SELECT sum(c.n / t.n * ln(c.n * t.n / (a.x * b.x))) FROM c JOIN a USING (cluster) JOIN b USING (label)) AS mi FROM t)"""


@query("external_scores", f"WITH {EXTERNAL} SELECT round((sc - sa * sb / s) / ((sa + sb) / 2 - sa * sb / s), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / hb, 6) AS homogeneity, round(mi / ha, 6) AS completeness FROM k")
def _(spark, d):
    return cluster.external_scores(table(spark, d, "documents").selectExpr("source AS cluster", "lang AS label"))


@query("cluster_purity", "WITH g AS (SELECT CAST(doc_id % 7 AS BIGINT) - 1 AS cluster, lang AS label FROM documents), c AS (SELECT cluster, label, count(*) AS n FROM g WHERE cluster <> -1 GROUP BY ALL) SELECT cluster, first(label ORDER BY n DESC, label) AS majority, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n), 6) AS purity, round(max(n) / (SELECT count(*) FROM g), 6) AS mapped_share FROM c GROUP BY cluster")
def _(spark, d):
    return cluster.purity(table(spark, d, "documents").selectExpr("doc_id % 7 - 1 AS cluster", "lang AS label"))


DIMS = ["l_quantity", "l_discount", "l_tax"]
SQ = lambda a, b: " + ".join(f"pow({a}.{c} - {b}.{c}, 2)" for c in DIMS)


@query("internal_scores", f"""WITH x AS (SELECT l_linenumber AS cluster, {', '.join(f'{c}::DOUBLE AS {c}' for c in DIMS)} FROM lineitem), m AS (SELECT cluster, count(*) AS size, {', '.join(f'avg({c}) AS {c}' for c in DIMS)} FROM x GROUP BY cluster), g AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in DIMS)} FROM x),
s AS (SELECT x.cluster, avg(sqrt({SQ('x', 'm')})) AS s, sum({SQ('x', 'm')}) AS w FROM x JOIN m ON x.cluster = m.cluster GROUP BY x.cluster), r AS (SELECT a.cluster, max((sa.s + sb.s) / sqrt({SQ('a', 'b')})) AS r FROM m a JOIN m b ON a.cluster <> b.cluster JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY a.cluster)
SELECT (SELECT count(*) FROM m) AS clusters, (SELECT round(avg(r), 4) FROM r) AS davies_bouldin, round((SELECT sum(size * ({SQ('m', 'g')})) FROM m, g) / ((SELECT count(*) FROM m) - 1) / ((SELECT sum(w) FROM s) / ((SELECT count(*) FROM x) - (SELECT count(*) FROM m))), 6) AS calinski_harabasz""")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("cluster"), *[F.col(c).cast("double").alias(c) for c in DIMS])
    return cluster.internal_scores(x, DIMS).withColumn("davies_bouldin", F.round("davies_bouldin", 4))


@query("dbscan", """WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) >= 0.28::DOUBLE),
core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) + 1 >= 10), e AS (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)), reach(id, r) AS (SELECT id, id FROM core UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r), named AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id),
border AS (SELECT a AS id, arg_min(cluster, b) AS cluster FROM p JOIN named ON named.id = b WHERE a NOT IN (FROM core) GROUP BY a)
SELECT v.id, coalesce(n.cluster, b.cluster, -1) AS cluster FROM v LEFT JOIN named n ON n.id = v.id LEFT JOIN border b ON b.id = v.id""")
def _(spark, d):
    return cluster.dbscan(table(spark, d, "embeddings"), 0.72, 10)


@query("kmeans_sweep")
def _(spark, d):
    return cluster.kmeans_sweep(table(spark, d, "embeddings"), [2, 3, 4, 5, 6, 8, 10, 12, 15, 20], "embedding")


@query("kmeans_search_seg")
def _(spark, d):
    x = features.impute_scale(customers(spark, d), NINE).select("id", F.array(*NINE).alias("v"))
    sweep = cluster.kmeans_sweep(x, list(range(2, 9)), "v", metric="squared")
    best = sweep.orderBy(F.desc("silhouette"), "k").first()["k"]
    return cluster.kmeans(x, best, "v").groupBy("cluster").agg(F.count("*").alias("n"))


@query("gmm")
def _(spark, d):
    x = features.impute_scale(customers(spark, d), NINE).select("id", F.array(*NINE[:4]).alias("v"))
    return cluster.mixture(x, 5, "v").select("id", "cluster")


@query("agglomerative_ward")
def _(spark, d):
    return cluster.ward(table(spark, d, "embeddings"), 5, "vec_id", "embedding")


@query("pca2")
def _(spark, d):
    x, _ = cluster.pca2(features.impute_scale(customers(spark, d), NINE), NINE)
    return x.select("id", "pc1", "pc2")
