"""Itemsets and rules over the orders' brands, with the order priority as class."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from granary.operators import mining
from granary.plans.catalog import query, table
from granary.sources.store import written

SUPPORT = 0.001
ITEMS = "items AS MATERIALIZED (SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL), tot AS (SELECT count(DISTINCT tid) AS total FROM items)"
SETS = ITEMS + f""", l1 AS MATERIALIZED (SELECT [item] AS items, 1 AS size, count(*) AS n FROM items GROUP BY item HAVING count(*) >= (SELECT ceil({SUPPORT} * total) FROM tot)),
l2 AS MATERIALIZED (SELECT [a.item, b.item] AS items, 2 AS size, count(*) AS n FROM items a JOIN items b ON a.tid = b.tid AND a.item < b.item GROUP BY ALL HAVING count(*) >= (SELECT ceil({SUPPORT} * total) FROM tot)),
l3 AS MATERIALIZED (SELECT [a.item, b.item, c.item] AS items, 3 AS size, count(*) AS n FROM items a JOIN items b ON a.tid = b.tid AND a.item < b.item JOIN items c ON a.tid = c.tid AND b.item < c.item GROUP BY ALL HAVING count(*) >= (SELECT ceil({SUPPORT} * total) FROM tot)),
sets AS MATERIALIZED (SELECT *, n / total AS support FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3), tot)"""
RULES = SETS + """, sub AS MATERIALIZED (SELECT items, n, total, unnest(CASE WHEN size = 2 THEN list_transform(items, lambda x: [x]) ELSE list_concat(list_transform(items, lambda x: [x]), list_transform(items, lambda x: list_filter(items, lambda y: y <> x))) END) AS antecedent FROM sets WHERE size > 1),
s2 AS MATERIALIZED (SELECT *, list_filter(items, lambda x: NOT list_contains(antecedent, x)) AS consequent FROM sub),
rules AS (SELECT antecedent, consequent, s2.n / s2.total AS support, s2.n / a.n AS confidence, s2.n / a.n / (c.n / s2.total) AS lift, s2.n / s2.total - (a.n / s2.total) * (c.n / s2.total) AS leverage, (1 - c.n / s2.total) / greatest(1 - s2.n / a.n, 1e-6::DOUBLE) AS conviction FROM s2 JOIN sets a ON a.items = antecedent JOIN sets c ON c.items = consequent),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, antecedent, consequent) AS rule_rank FROM rules QUALIFY rule_rank <= 250)"""
CLASSES = ITEMS + """, lab AS (SELECT o_orderkey AS tid, o_orderpriority AS label FROM orders), pri AS (SELECT label, count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY label),
fi AS (SELECT * FROM items WHERE item IN (SELECT item FROM items GROUP BY item HAVING count(*) >= 30)),
cs AS (SELECT tid, [item] AS items FROM fi UNION ALL SELECT a.tid, [a.item, b.item] FROM fi a JOIN fi b ON a.tid = b.tid AND a.item < b.item),
cm AS (SELECT items, label, count(*) AS matching FROM cs JOIN lab USING (tid) GROUP BY ALL), ct AS (SELECT *, sum(matching) OVER (PARTITION BY items) AS support_docs FROM cm),
cr AS (SELECT items, CAST(len(items) AS INTEGER) AS size, CAST(support_docs AS BIGINT) AS support_docs, label, matching, round(matching / support_docs, 6) AS confidence, round(matching / support_docs / p, 6) AS lift FROM ct JOIN pri USING (label) WHERE support_docs >= 30)"""
COMPARED = CLASSES + """, best AS (SELECT *, row_number() OVER (PARTITION BY items ORDER BY confidence DESC, label) AS k FROM cr QUALIFY k = 1),
cmp AS (SELECT x.items, x.label, x.confidence, x.support_docs, CASE WHEN a.confidence >= b.confidence THEN a.items[1] ELSE b.items[1] END AS best_parent, greatest(a.confidence, b.confidence) AS parent_confidence, round(x.confidence - greatest(a.confidence, b.confidence), 6) AS gain, x.label <> CASE WHEN a.confidence >= b.confidence THEN a.label ELSE b.label END AS changed
FROM best x JOIN best a ON a.size = 1 AND a.items[1] = x.items[1] JOIN best b ON b.size = 1 AND b.items[1] = x.items[2] WHERE x.size = 2)"""


def items(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return mining.items_of(lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand")


def sets(spark, d):
    return written(mining.frequent_itemsets(items(spark, d), SUPPORT), "itemsets")  # read by every join of the rules


def rounded(df, *cols):
    return df.select(*[F.round(c, 9).alias(c) if c in cols else c for c in df.columns])


@query("apriori", f"WITH {SETS} SELECT items, size, n, round(support, 9) AS support FROM sets")
def _(spark, d):
    return rounded(sets(spark, d).drop("total"), "support")


@query("eclat_parity", f"WITH {SETS} SELECT items, size, n FROM sets")
def _(spark, d):
    x = written(items(spark, d), "items")
    total = x.select("tid").distinct().count()
    return mining.eclat(x, max(1, math.ceil(SUPPORT * total - 1e-9)), 3)


@query("tidset_intersection", f"WITH {ITEMS} SELECT a.item AS a, b.item AS b, count(*) AS n FROM items a JOIN items b ON a.tid = b.tid AND a.item < b.item GROUP BY ALL")
def _(spark, d):
    return mining.supports_by_pairs(items(spark, d))


NUMBERS = ("support", "confidence", "lift", "leverage", "conviction")
SHOWN = ", ".join(f"round({c}, 9) AS {c}" for c in NUMBERS)


@query("assoc_rules", f"WITH {RULES} SELECT antecedent, consequent, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM rules")
def _(spark, d):
    return rounded(mining.rules(sets(spark, d)), *NUMBERS).drop("leverage", "conviction")


@query("assoc_rules_full", f"WITH {RULES} SELECT antecedent, consequent, {SHOWN} FROM rules WHERE confidence >= 0.05::DOUBLE AND lift >= 1.05::DOUBLE")
def _(spark, d):
    return rounded(mining.rules(sets(spark, d), 0.05, 1.05), *NUMBERS)


@query("rule_filter", f"WITH {RULES} SELECT antecedent, consequent, round(lift, 6) AS lift FROM rules WHERE lift >= 1.1::DOUBLE AND len(list_filter(antecedent, lambda x: contains(x, '#1'))) > 0")
def _(spark, d):
    return mining.rules(sets(spark, d)).where((F.col("lift") >= 1.1) & F.exists("antecedent", lambda x: x.contains("#1"))).select("antecedent", "consequent", F.round("lift", 6).alias("lift"))


def ranked(spark, d):
    return mining.best_rules(mining.rules(sets(spark, d)))


@query("rule_sort", f"WITH {RULES} SELECT antecedent, consequent, CAST(rule_rank AS INTEGER) AS rule_rank FROM ranked")
def _(spark, d):
    return ranked(spark, d).select("antecedent", "consequent", "rule_rank")


@query("recommend", f"""WITH {RULES}, b AS (SELECT tid, list_sort(list(item)) AS w FROM items GROUP BY tid), k AS (SELECT tid, w, unnest(list_concat(list_transform(w, lambda x: [x]), (SELECT list([p.x, p.y]) FROM (SELECT u.x, v.x AS y FROM unnest(w) u(x), unnest(w) v(x) WHERE u.x < v.x) p))) AS antecedent FROM b),
h AS (SELECT tid, w, rule_rank, lift, confidence, unnest(consequent) AS item FROM k JOIN ranked USING (antecedent)), g AS (SELECT tid, item, min(rule_rank) AS rule_rank FROM h WHERE NOT list_contains(w, item) GROUP BY ALL),
o AS (SELECT tid, item, rule_rank, row_number() OVER (PARTITION BY tid ORDER BY rule_rank, item) AS rank FROM g)
SELECT tid, CAST(rank AS INTEGER) AS rank, o.item, round(lift, 9) AS lift, round(confidence, 9) AS confidence FROM o JOIN ranked USING (rule_rank) WHERE rank <= 5""")
def _(spark, d):
    baskets = items(spark, d).groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return rounded(mining.recommend(baskets, ranked(spark, d)), "lift", "confidence")


@query("subset_lookup", f"WITH {RULES}, b AS (SELECT tid, list(item) AS w FROM items GROUP BY tid) SELECT rule_rank, count(*) AS baskets FROM b JOIN ranked ON list_has_all(w, antecedent) GROUP BY rule_rank")
def _(spark, d):
    baskets = items(spark, d).groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    own = F.expr("concat(transform(items, x -> array(x)), flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> array(x, y)))))")
    return baskets.select(F.explode(own).alias("antecedent")).join(ranked(spark, d).select("antecedent", F.col("rule_rank").cast("long").alias("rule_rank")), "antecedent").groupBy("rule_rank").agg(F.count("*").alias("baskets"))


@query("class_rules", f"WITH {CLASSES} SELECT * FROM cr")
def _(spark, d):
    return mining.class_rules(items(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderpriority").alias("label")))


def compared(spark, d):
    return mining.pairs_vs_singletons(mining.class_rules(items(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderpriority").alias("label"))))


@query("pairs_vs_singletons", f"WITH {COMPARED} SELECT * FROM cmp")
def _(spark, d):
    return compared(spark, d)


@query("gain_summary", f"WITH {COMPARED} SELECT count(*) AS n_pairs, round(avg(gain), 6) AS mean_gain, round(median(gain), 6) AS median_gain, round(avg((gain > 0)::INTEGER), 6) AS better, round(avg((gain > 0.1::DOUBLE)::INTEGER), 6) AS over_10_points, round(avg(changed::INTEGER), 6) AS changing FROM cmp")
def _(spark, d):
    return mining.gain_summary(compared(spark, d))


@query("best_two_per_class", f"WITH {CLASSES}, f AS (SELECT *, row_number() OVER (PARTITION BY items ORDER BY lift DESC, label) AS k FROM cr QUALIFY k = 1) SELECT label, items, lift, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lift DESC, items) AS rank FROM f) WHERE rank <= 2")
def _(spark, d):
    from granary.operators.vocab import top_k

    rules = mining.class_rules(items(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderpriority").alias("label")))
    first = top_k(rules, 1, ["items"], F.desc("lift"), "label").drop("rank")
    return top_k(first, 2, ["label"], F.desc("lift"), "items").select("label", "items", "lift", "rank")


@query("rule_graph", f"WITH {RULES}, t AS (SELECT items[1] AS item FROM sets WHERE size = 1 ORDER BY n DESC, items LIMIT 16) SELECT antecedent[1] AS source, consequent[1] AS target, round(lift, 6) AS lift, CAST(rule_rank AS INTEGER) AS rule_rank FROM (SELECT *, row_number() OVER (ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, antecedent, consequent) AS rule_rank FROM rules WHERE len(antecedent) = 1 AND len(consequent) = 1) WHERE antecedent[1] IN (FROM t) AND consequent[1] IN (FROM t) ORDER BY rule_rank LIMIT 24")
def _(spark, d):
    s = sets(spark, d)
    return mining.rule_graph(s, mining.rules(s.where("size <= 2")))


GRID = [0.001, 0.0015, 0.002, 0.005, 0.01, 0.1]


@query("threshold_sweep", f"WITH {RULES}, g AS (SELECT unnest({GRID})::DOUBLE AS min_support) SELECT min_support, (SELECT count(*) FROM sets WHERE support >= min_support) AS itemsets, (SELECT count(*) FROM rules WHERE support >= min_support) AS rules FROM g")
def _(spark, d):
    s = sets(spark, d)
    return mining.threshold_sweep(s, mining.rules(s), GRID)


@query("item_counts", f"WITH {ITEMS} SELECT item, count(*) AS n, round(count(*) / (SELECT total FROM tot), 6) AS share FROM items GROUP BY item ORDER BY n DESC, item LIMIT 20")
def _(spark, d):
    x = items(spark, d)
    total = x.select("tid").distinct().agg(F.count("*").alias("total"))
    return x.groupBy("item").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("item", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), "item").limit(20)


@query("basket_summary", f"WITH {ITEMS} SELECT (SELECT total FROM tot) AS baskets, count(DISTINCT item) AS items, round(count(*) / (SELECT total FROM tot), 6) AS mean_size FROM items")
def _(spark, d):
    x = items(spark, d)
    return x.groupBy("tid").agg(F.count("*").alias("k")).agg(F.count("*").alias("baskets"), F.round(F.sum("k") / F.count("*"), 6).alias("mean_size")).crossJoin(x.select("item").distinct().agg(F.count("*").alias("items")))


@query("join_many_to_one", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    from granary.sources.readers import many_to_one

    return many_to_one(table(spark, d, "lineitem"), table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey").select("l_partkey", "p_brand"), "l_partkey").select("l_orderkey", "l_linenumber", "p_brand")


@query("lookup_dim", "SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'Other') AS brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def _(spark, d):
    dim = table(spark, d, "part").where("p_size < 25").select("p_partkey", "p_brand")
    return table(spark, d, "lineitem").join(dim, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("p_brand", F.lit("Other")).alias("brand"))


@query("sample_orders", "WITH s AS (SELECT o_orderkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 500) SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (FROM s) GROUP BY l_orderkey")
def _(spark, d):
    keys = table(spark, d, "orders").select("o_orderkey").distinct().orderBy(F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(500)
    return table(spark, d, "lineitem").join(F.broadcast(keys), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))
