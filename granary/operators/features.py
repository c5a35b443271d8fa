"""Features: TF-IDF, geo-temporal trip features, customer features, imputing and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.operators.quantiles import quantiles

EARTH_KM = 6371.0088
#: Bounds of a trip that is kept: longitude, latitude, passengers, seconds.
LON, LAT, RIDERS, SECONDS = (-74.15, -73.70), (40.55, 40.95), (1, 6), (60, 7200)


def terms(text: Column, bigrams: bool) -> Column:
    t = tokens(text)
    return F.concat(t, F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))) if bigrams else t


def idf(train: DataFrame, text: str = "text", min_df: int = 2, bigrams: bool = False) -> DataFrame:
    """(term, idf) fitted on the training rows only: ln((1 + n) / (1 + df)) + 1. A row is a document, and its distinct terms are found within it, so that the only shuffle is that of counts by term."""
    n = train.agg(F.count("*").alias("n_docs"))
    df = train.select(F.explode(F.array_distinct(terms(F.col(text), bigrams))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where(F.col("df") >= min_df).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, weights: DataFrame, doc: str = "doc_id", text: str = "text", bigrams: bool = False) -> DataFrame:
    """(doc, term, w): sublinear counts times idf, each document of length 1. Unknown terms are left out.

    Texts move once, by document: counts and lengths need no further shuffle where the weights are small enough for Spark to broadcast them."""
    tf = df.select(doc, text).repartition(doc).select(doc, F.explode(terms(F.col(text), bigrams)).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    x = tf.join(weights, "term").withColumn("u", (1 + F.log("tf")) * F.col("idf"))
    return x.select(doc, "term", (F.col("u") / F.sqrt(F.sum(F.col("u") * F.col("u")).over(W.partitionBy(doc)))).alias("w"))


def tfidf_stats(df: DataFrame, weighted: DataFrame, weights: DataFrame, doc: str = "doc_id") -> DataFrame:
    per = weighted.groupBy(doc).agg(F.count("*").alias("k"))
    a = per.agg(F.sum("k").alias("nnz"), F.count("*").alias("rows_with_terms"))
    return a.crossJoin(df.agg(F.count("*").alias("rows"))).crossJoin(weights.agg(F.count("*").alias("vocabulary"))).select("vocabulary", "rows", "nnz", F.round(F.col("nnz") / (F.col("rows") * F.col("vocabulary")), 8).alias("density"), F.round(F.col("nnz") / F.col("rows"), 6).alias("nnz_per_row"), (F.col("rows") - F.col("rows_with_terms")).alias("empty_rows"))


# ---- trips ----

def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def trip_ok(seconds: Column | None = None) -> Column:
    c = F.lit(True)
    for k in ("lon1", "lon2"):
        c = c & F.col(k).between(*LON)
    for k in ("lat1", "lat2"):
        c = c & F.col(k).between(*LAT)
    c = c & F.col("riders").between(*RIDERS) & F.col("started").isNotNull()
    return c if seconds is None else c & seconds.between(*SECONDS)


def trip_features(df: DataFrame) -> DataFrame:
    """The 16 features of trips(lon1, lat1, lon2, lat2, started, riders, vendor), the same for batches and single requests."""
    lat1, lon1, lat2, lon2 = (F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))
    dlon = F.radians(lon2 - lon1)
    bearing = F.atan2(F.sin(dlon) * F.cos(F.radians(lat2)), F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon))
    hour = F.hour("started") + F.minute("started") / 60
    day = F.weekday("started")
    turn = 2 * F.lit(3.141592653589793)
    rush = hour.between(7, 10) | hour.between(16, 19)
    named = {
        "distance_km": haversine(lat1, lon1, lat2, lon2), "manhattan_km": haversine(lat1, lon1, lat2, lon1) + haversine(lat1, lon1, lat1, lon2),
        "bearing_sin": F.sin(bearing), "bearing_cos": F.cos(bearing), "hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24),
        "dow_sin": F.sin(turn * day / 7), "dow_cos": F.cos(turn * day / 7), "is_weekend": (day >= 5).cast("int"), "is_rush_hour": rush.cast("int"),
    }
    return df.select("*", *[c.alias(k) for k, c in named.items()], hour.alias("hour"))


FEATURES = ["lon1", "lat1", "lon2", "lat2", "riders", "vendor", "distance_km", "manhattan_km", "bearing_sin", "bearing_cos", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "is_rush_hour"]


def fare(df: DataFrame, seconds: Column) -> DataFrame:
    """Duration held to 60..7200 s, minutes, fare and traffic band of trips with features."""
    s = F.greatest(F.lit(SECONDS[0]), F.least(F.lit(SECONDS[1]), F.floor(seconds + 0.5)))
    rush = F.col("is_rush_hour") == 1
    band = F.when(rush, "Heavy").when(F.col("hour").between(7, 21), "Moderate").otherwise("Light")
    price = 3 + F.col("distance_km") * 1.85 + s / 60 * 0.48 + F.when(rush, 2.5).otherwise(0.0)
    return df.withColumn("duration_seconds", s.cast("long")).withColumn("fare_usd", price).withColumn("traffic_band", band)


# ---- customers ----

def day_first(text: Column) -> Column:
    """A dd-MM-yyyy date; what isn't one is null."""
    return F.try_to_timestamp(text, F.lit("dd-MM-yyyy")).cast("date")


def customer_features(df: DataFrame, as_of: str) -> DataFrame:
    """customers(id, birth_year, joined, income, kids, teens, spend array, web, catalog, store, visits, accepted array) to nine features. Tenure counts from the day after the last join date; ages outside 18..100 and negative spend go."""
    ref = df.agg(F.date_add(F.max("joined"), 1).alias("_ref"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    x = df.crossJoin(F.broadcast(ref)).withColumn("total_spend", total("spend")).withColumn("total_purchases", (F.col("web") + F.col("catalog") + F.col("store")).cast("double"))
    y = x.select(
        "id", (F.year(F.lit(as_of).cast("date")) - F.col("birth_year")).cast("double").alias("age"), F.when(F.isnan("income") | (F.abs("income") == float("inf")), None).otherwise(F.col("income")).alias("income"),
        F.datediff("_ref", "joined").cast("double").alias("customer_tenure_days"), (F.col("kids") + F.col("teens")).cast("double").alias("children"), "total_spend", "total_purchases",
        (F.col("total_spend") / F.greatest("total_purchases", F.lit(1.0))).alias("average_basket"), total("accepted").alias("campaign_acceptance"), (F.col("web") / F.greatest(F.col("visits"), F.lit(1))).cast("double").alias("web_conversion"),
    )
    return y.where(F.col("age").between(18, 100) & (F.col("total_spend") >= 0))


def impute_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls become the column's exact median; then each column has mean 0 and population deviation 1 (a constant one stays 0)."""
    med = quantiles(df, {f"_m_{c}": F.col(c) for c in cols}, [0.5]).select(*[F.col(f"_m_{c}")[0].alias(f"_m_{c}") for c in cols])
    x = df.crossJoin(F.broadcast(med)).select(*[c for c in df.columns if c not in cols], *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in cols])
    stat = x.agg(*[e for c in cols for e in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    return x.crossJoin(F.broadcast(stat)).select(*[c for c in df.columns if c not in cols], *[((F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) for c in cols])
