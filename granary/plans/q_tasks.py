"""Task snapshots made from the orders, sequences from the conversations, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import profile, sequences, tasks
from granary.plans.catalog import ASCII_LOW, ASCII_UP, CORPUS, corpus, query, split_of, table
from granary.sources import readers, synth, writers
from granary.sources.store import new_path

TODAY, NOW = "1996-06-15", "2024-01-01T00:00:00Z"
TASKS = """tasks AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, o_orderpriority AS notes, CASE WHEN o_orderpriority < '2' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS priority, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due_date,
CASE WHEN o_orderkey % 4 = 0 THEN ['Home', 'c' || (o_orderkey % 3)] WHEN o_orderkey % 4 = 1 THEN ['work'] ELSE CAST([] AS VARCHAR[]) END AS tags, o_orderstatus = 'F' AS completed, o_orderkey % 1000 AS position, strftime(o_orderdate, '%Y-%m-%d') AS created_at, '0' AS updated_at, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE NULL END AS completed_at FROM orders)"""


def snapshot(spark, d):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 4 == 0, F.concat(F.lit('["Home","c'), (k % 3).cast("string"), F.lit('"]'))).when(k % 4 == 1, '["work"]').when(k % 4 == 2, "not json").otherwise("[]")
    return table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.col("o_orderpriority").alias("notes"), F.when(F.col("o_orderpriority") < "2", "high").when(F.col("o_orderpriority") < "4", "medium").otherwise("low").alias("priority"),
        F.when(k % 5 == 0, None).otherwise(day).alias("due_date"), tasks.tags_from_json(raw).alias("tags"), (F.col("o_orderstatus") == "F").alias("completed"), (k % 1000).alias("position"), day.alias("created_at"), F.lit("0").alias("updated_at"), F.when(F.col("o_orderstatus") == "F", "1").alias("completed_at"),
    )


@query("task_view", f"WITH {TASKS} SELECT 'today' AS name, id FROM tasks WHERE NOT completed AND due_date <= '{TODAY}' UNION ALL SELECT 'upcoming', id FROM tasks WHERE NOT completed AND due_date > '{TODAY}' UNION ALL SELECT 'completed', id FROM tasks WHERE completed")
def _(spark, d):
    t = snapshot(spark, d)
    return profile.union_all([tasks.view(t, n, TODAY).select(F.lit(n).alias("name"), "id") for n in ("today", "upcoming", "completed")])


@query("task_search", f"WITH {TASKS} SELECT id FROM tasks WHERE contains(lower(title), '77') OR contains(lower(notes), '77') OR len(list_filter(tags, lambda t: contains(lower(t), '77'))) > 0 UNION ALL SELECT -id FROM tasks WHERE contains(lower(title), 'home') OR contains(lower(notes), 'home') OR len(list_filter(tags, lambda t: contains(lower(t), 'home'))) > 0")
def _(spark, d):
    t = snapshot(spark, d)
    return tasks.search(t, "77").select("id").unionByName(tasks.search(t, "HOME").select((-F.col("id")).alias("id")))


ORDERS = {"manual": "completed, position, created_at DESC", "due": "coalesce(due_date, '9999')", "priority": "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END", "created": "created_at DESC"}


#: Every task with its place.
PLACES = {m: f"SELECT '{m}' AS mode, id, row_number() OVER (ORDER BY {o}, id) AS place FROM tasks" for m, o in ORDERS.items()}


@query("task_sort_modes", f"WITH {TASKS} " + " UNION ALL ".join(PLACES.values()))
def _(spark, d):
    t = snapshot(spark, d)
    return profile.union_all([tasks.places(t, m).select(F.lit(m).alias("mode"), "id", "place") for m in ORDERS])


@query("task_order", f"WITH {TASKS} SELECT id, place FROM ({PLACES['manual']})")
def _(spark, d):
    return tasks.places(snapshot(spark, d), "manual")


@query("task_counts", f"WITH {TASKS} SELECT count(*) FILTER (NOT completed) AS open, count(*) FILTER (NOT completed AND due_date <= '{TODAY}') AS today, count(*) FILTER (NOT completed AND due_date > '{TODAY}') AS upcoming, count(*) FILTER (completed) AS completed, round(100 * count(*) FILTER (completed) / count(*), 6) AS progress FROM tasks")
def _(spark, d):
    return tasks.counts(snapshot(spark, d), TODAY)


@query("next_position", f"WITH {TASKS} SELECT coalesce(max(position), -1) + 1 AS position FROM tasks")
def _(spark, d):
    return tasks.next_position(snapshot(spark, d))


@query("tags_top6", f"WITH {TASKS} SELECT DISTINCT unnest(tags) AS tag FROM tasks ORDER BY tag LIMIT 6")
def _(spark, d):
    return snapshot(spark, d).select(F.explode("tags").alias("tag")).distinct().orderBy("tag").limit(6)


STATE = "id, title, priority, due_date, tags, completed, position, updated_at, completed_at"


def state(df):
    return df.select(*STATE.split(", "))


@query("task_insert", f"WITH {TASKS} SELECT {STATE} FROM tasks UNION ALL SELECT 1000001, 'New', 'medium', NULL, ['a', 'b'], false, (SELECT max(position) + 1 FROM tasks), '{NOW}', NULL UNION ALL SELECT 1000002, 'Second', 'medium', NULL, CAST([] AS VARCHAR[]), false, (SELECT max(position) + 2 FROM tasks), '{NOW}', NULL")
def _(spark, d):
    drafts = spark.createDataFrame([(1000001, " New ", [" A", "b ", "a", " "]), (1000002, "Second", None)], "id long, title string, tags array<string>")
    return state(tasks.insert(snapshot(spark, d), drafts, NOW))


@query("task_update", f"WITH {TASKS} SELECT id, CASE WHEN id % 7 = 0 THEN 'Changed' ELSE title END AS title, priority, CASE WHEN id % 14 = 0 THEN NULL ELSE due_date END AS due_date, tags, CASE WHEN id % 7 = 0 THEN id % 3 = 0 ELSE completed END AS completed, position, CASE WHEN id % 7 = 0 THEN '{NOW}' ELSE updated_at END AS updated_at, CASE WHEN id % 7 <> 0 THEN completed_at WHEN id % 3 = 0 THEN coalesce(completed_at, '{NOW}') ELSE NULL END AS completed_at FROM tasks")
def _(spark, d):
    t = snapshot(spark, d)
    p = t.where("id % 7 = 0").select("id", F.lit("Changed").alias("title"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("priority"), F.lit(None).cast("array<string>").alias("tags"), (F.col("id") % 3 == 0).alias("completed"), (F.col("id") % 14 == 0).alias("has_due_date"), F.lit(None).cast("string").alias("due_date"))
    return state(tasks.update(t, p, NOW))


@query("task_delete", f"WITH {TASKS} SELECT {STATE} FROM tasks WHERE id % 10 <> 0")
def _(spark, d):
    t = snapshot(spark, d)
    return state(tasks.delete(t, t.where("id % 10 = 0")))


@query("task_bulk_complete", f"WITH {TASKS} SELECT id, title, priority, due_date, tags, completed OR id % 6 = 0 AS completed, position, CASE WHEN id % 6 = 0 THEN '{NOW}' ELSE updated_at END AS updated_at, CASE WHEN id % 6 = 0 THEN '{NOW}' ELSE completed_at END AS completed_at FROM tasks")
def _(spark, d):
    t = snapshot(spark, d)
    return state(tasks.bulk_complete(t, t.where("id % 6 = 0"), True, NOW))


@query("task_reorder", f"WITH {TASKS}, o AS (SELECT unnest([5, 3, 1, 4]) AS id, unnest([0, 1, 2, 3]) AS p) SELECT tasks.id, coalesce(o.p, position) AS position FROM tasks LEFT JOIN o ON o.id = tasks.id")
def _(spark, d):
    return tasks.reorder(snapshot(spark, d), [5, 3, 1, 4]).select("id", "position")


@query("integrity", f"WITH {TASKS} SELECT 'id' AS rule, count(*) FILTER (id IS NULL) AS n_bad FROM tasks UNION ALL SELECT 'title', count(*) FILTER (NOT length(title) BETWEEN 1 AND 140) FROM tasks UNION ALL SELECT 'priority', count(*) FILTER (priority NOT IN ('high', 'medium', 'low')) FROM tasks UNION ALL SELECT 'completed_at', count(*) FILTER (NOT (completed OR completed_at IS NULL)) FROM tasks")
def _(spark, d):
    return profile.violations(snapshot(spark, d), tasks.rules())


@query("gen_seed_rows", f"WITH {TASKS}, s AS (SELECT * FROM tasks WHERE id % 100 = 0), t AS (SELECT * FROM tasks WHERE id % 3 = 0) SELECT id FROM t UNION ALL SELECT id FROM s WHERE id NOT IN (SELECT id FROM t)")
def _(spark, d):
    all_ = snapshot(spark, d)
    meta = spark.createDataFrame([("seed_v1", "1")], "key string, value string")
    return tasks.seed_once(all_.where("id % 3 = 0"), meta, all_.where("id % 100 = 0"), "v2")[0].select("id")


@query("date_label", f"WITH {TASKS} SELECT id, CASE WHEN due_date = '{TODAY}' THEN 'Today' WHEN due_date = '1996-06-16' THEN 'Tomorrow' ELSE due_date END AS label FROM tasks")
def _(spark, d):
    return snapshot(spark, d).select("id", tasks.date_label(F.col("due_date"), TODAY).alias("label"))


# ---- sequences ----

@query("byte_tokens", "SELECT doc_id, octet_length(encode(text)) AS n_bytes, list_sum(list_transform(range(1, octet_length(encode(text)) + 1), lambda i: CAST(('0x' || substr(hex(encode(text)), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT) + 6))::BIGINT AS id_sum FROM (SELECT doc_id, left(text, 0) || text AS text FROM benchmark_docs)".replace("benchmark_docs", "(SELECT item_id AS doc_id, text FROM benchmark)"))
def _(spark, d):
    from granary.functions.text import byte_ids

    ids = byte_ids(F.col("text"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.size(ids).cast("long").alias("n_bytes"), F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


@query("byte_decode", "SELECT item_id, md5(text) AS h FROM benchmark")
def _(spark, d):
    """Texts from their token ids."""
    from granary.functions.text import byte_ids, decoded

    return table(spark, d, "benchmark").select("item_id", F.md5(decoded(byte_ids(F.col("text")))).alias("h"))


@query("token_inspect", "WITH b AS (SELECT item_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM benchmark) SELECT item_id, CAST(i AS INTEGER) AS \"index\", CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) + 6 AS token_id, CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) AS byte FROM b")
def _(spark, d):
    return sequences.token_inspect(table(spark, d, "benchmark"), "item_id", "text").drop("piece")


TURNS = "turns AS (SELECT conv_id, turn, role, text AS u, lead(role) OVER w AS nr, lead(text) OVER w AS a, coalesce(max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id), 'You are a concise, helpful assistant.') AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), ex AS (SELECT conv_id, turn, s, u, a FROM turns WHERE role = 'user' AND nr = 'assistant')"


@query("chat_examples", f"WITH {TURNS}, n AS (SELECT conv_id, turn, 4 + octet_length(encode(trim(s))) + octet_length(encode(trim(u))) + 2 AS p, octet_length(encode(trim(a))) AS m FROM ex) SELECT conv_id, turn, CAST(p AS INTEGER) AS prompt_len, CAST(least(p + m + 1, 513) - 1 AS BIGINT) AS real_ids, CAST(greatest(least(p + m + 1, 513) - p, 0) AS BIGINT) AS answer_ids FROM n")
def _(spark, d):
    x = sequences.chat_examples(sequences.turns(table(spark, d, "conversations"), readers.DEFAULT_SYSTEM), 512)
    return x.select("conv_id", "turn", "prompt_len", F.size(F.filter("input_ids", lambda t: t != 0)).cast("long").alias("real_ids"), F.size(F.filter("labels", lambda t: t != -100)).cast("long").alias("answer_ids"))


@query("chat_messages", f"WITH {TURNS} SELECT conv_id, turn, 4 AS n, 'system' AS first_role, md5(u) AS last_hash FROM ex")
def _(spark, d):
    x = sequences.turns(table(spark, d, "conversations"), readers.DEFAULT_SYSTEM)
    shots = F.array(F.struct(F.lit("q").alias("user"), F.lit("a").alias("assistant")))
    m = sequences.chat_messages(F.col("system"), shots, F.col("user"))
    return x.select("conv_id", "turn", F.size(m).alias("n"), m[0]["role"].alias("first_role"), F.md5(F.element_at(m, -1)["content"]).alias("last_hash"))


@query("lr_schedule", "SELECT i AS step, round(CASE WHEN i < 80 THEN 0.001::DOUBLE * (i + 1) / 80 ELSE 0.001::DOUBLE * (0.1::DOUBLE + 0.45::DOUBLE * (1 + cos(pi() * ((i - 80) / 920)))) END, 12) AS rate FROM range(1000) t(i)")
def _(spark, d):
    return sequences.lr_schedule(spark, 1000, 0.001).select("step", F.round("rate", 12).alias("rate"))


@query("perplexity", "SELECT event_type, round(exp(least(avg(value) / 10, 20)), 4) AS perplexity FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(sequences.perplexity(F.avg("value") / 10), 4).alias("perplexity"))


@query("token_sampling", """WITH l AS (SELECT user_id AS prompt, event_id AS token, value / 20 AS logit FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY logit DESC, token) AS r FROM l QUALIFY r <= 40), e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY prompt)) / 0.8::DOUBLE) AS e FROM k), p AS (SELECT *, e / sum(e) OVER (PARTITION BY prompt) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY prompt ORDER BY logit DESC, token ROWS UNBOUNDED PRECEDING) - p AS before FROM p), f AS (SELECT * FROM c WHERE before < 0.9::DOUBLE) SELECT prompt, token, round(p / sum(p) OVER (PARTITION BY prompt), 6) AS p FROM f""")
def _(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("prompt"), F.col("event_id").alias("token"), (F.col("value") / 20).alias("logit"))
    return sequences.nucleus(x, 0.8, 40, 0.9).select("prompt", "token", F.round("p", 6).alias("p"))


H = "CAST(('0x' || substr(md5('7|' || doc_id), 1, 12)) AS BIGINT)"


@query("random_split", f"SELECT doc_id, CASE WHEN {H} < {int(0.8 * (1 << 48))} THEN 'train' ELSE 'test' END AS part FROM documents")
def _(spark, d):
    return sequences.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8)


@query("kfold", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents")
def _(spark, d):
    return sequences.folds(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "fold")


@query("stratified_sample_k", "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS i FROM documents QUALIFY i <= 3) SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY i, md5(lang), lang) AS INTEGER) AS turn FROM k")
def _(spark, d):
    return sequences.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 3)


@query("example_sample", "SELECT doc_id FROM documents WHERE n_chars > 3000 ORDER BY md5('7|' || doc_id), doc_id LIMIT 10")
def _(spark, d):
    return table(spark, d, "documents").where("n_chars > 3000").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id").limit(10).select("doc_id")


@query("class_weights", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def _(spark, d):
    return sequences.class_weights(table(spark, d, "documents"), "lang")


@query("sha_prefix", "SELECT doc_id, left(sha256(text), 12) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("h"))


# ---- sources and sinks ----

@query("scan_delim_last", r"SELECT doc_id, regexp_extract(l, '^(.*);([^;]*)$', 1) AS text, regexp_extract(l, '^(.*);([^;]*)$', 2) AS label FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x1F]+', ' ', 'g') || ';' || lang AS l FROM documents)")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.concat_ws(";", F.regexp_replace("text", r"[\x00-\x1F]+", " "), "lang").alias("value"))
    path = new_path(spark, "lines")
    df.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "value").alias("value")).write.text(path)
    x = spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.expr("substring(value, instr(value, '\\t') + 1)").alias("value"))
    ids = readers.split_lines(x.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "value").alias("value")))
    return ids.select(F.substring_index("text", "\t", 1).cast("long").alias("doc_id"), F.expr("substring(text, instr(text, '\\t') + 1)").alias("text"), "label")


@query("sink_parquet", f"WITH {CORPUS} SELECT doc_id, split FROM corpus")
def _(spark, d):
    path = new_path(spark, "frozen")
    writers.freeze(corpus(spark, d), path)
    return spark.read.parquet(path).select("doc_id", "split")


@query("scan_parquet", "SELECT doc_id, lang FROM documents WHERE n_chars < 500")
def _(spark, d):
    return table(spark, d, "documents").where("n_chars < 500").select("doc_id", "lang")


@query("scan_csv_project", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    path = new_path(spark, "csv")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o.write.csv(path, header=True)
    return readers.read_csv(spark, path, o.schema, ["o_orderkey", "o_totalprice"])


@query("scan_csv_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return readers.first_rows(table(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("scan_csv_sniff", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = new_path(spark, "tsv")
    table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.csv(path, header=True, sep="\t")
    return readers.read_sniffed(spark, path)


@query("scan_jsonl", f"WITH {TURNS} SELECT md5(s) AS s, md5(u) AS u, md5(a) AS a FROM ex")
def _(spark, d):
    path = new_path(spark, "jsonl")
    x = sequences.turns(table(spark, d, "conversations"), readers.DEFAULT_SYSTEM)
    x.select(F.when(F.col("system") != readers.DEFAULT_SYSTEM, F.col("system")).alias("system"), "user", "assistant").write.json(path)
    return readers.read_conversations(spark, path).select(F.md5("system").alias("s"), F.md5("user").alias("u"), F.md5("assistant").alias("a"))


@query("scan_json_metrics", "SELECT event_type AS model, round(avg(value), 6) AS macro_f1 FROM events GROUP BY event_type")
def _(spark, d):
    path = new_path(spark, "metrics")
    x = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("f"))
    x.select(F.to_json(F.struct(F.col("event_type").alias("model"), F.struct(F.struct(F.col("f").alias("macro_f1")).alias("quality")).alias("results"))).alias("value"), "event_type").write.partitionBy("event_type").text(path)
    docs = readers.read_metrics(spark, path)
    return docs.select(F.explode(F.split("value", "\n")).alias("v")).where("v <> ''").select(F.get_json_object("v", "$.model").alias("model"), F.get_json_object("v", "$.results.quality.macro_f1").cast("double").alias("macro_f1"))


@query("scan_csv_manifest", "SELECT n_name AS skill, CASE WHEN n_regionkey < 2 THEN 'base' ELSE 'extra' END AS origin FROM nation")
def _(spark, d):
    path = new_path(spark, "manifest")
    table(spark, d, "nation").select(F.when(F.col("n_regionkey") < 2, "base").otherwise("extra").alias("origin"), F.col("n_name").alias("skill"), F.lit("x").alias("dataset_slug"), F.lit("y").alias("evidence")).write.csv(path, header=True)
    return readers.read_manifest(spark, path).select("skill", "origin")


@query("manifest_check", "SELECT CASE WHEN n_regionkey < 2 THEN 'base' ELSE 'extra' END AS origin, count(*) AS n, count(DISTINCT n_name) AS skills, count(*) FILTER (trim(n_name) = '') AS blank FROM nation GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "nation").select(F.when(F.col("n_regionkey") < 2, "base").otherwise("extra").alias("origin"), "n_name")
    return x.groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("n_name").alias("skills"), F.count_if(F.trim("n_name") == "").alias("blank"))


@query("sink_json_report", "SELECT CAST(to_json(nation) AS VARCHAR) AS value FROM nation")
def _(spark, d):
    path = new_path(spark, "report")
    writers.json_report(table(spark, d, "nation"), path)
    return spark.read.text(path)


@query("sink_csv_report", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = new_path(spark, "report")
    writers.csv_report(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.csv(path, header=True)


@query("scan_npy", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width FROM embeddings")
def _(spark, d):
    return readers.read_vectors(spark, f"{d}/embeddings.parquet").select("vec_id", F.size("embedding").alias("width"))


@query("scan_sqlite", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    path = new_path(spark, "sqlite")
    writers.sqlite_file(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "nation")
    return readers.read_sqlite_files(spark, path, "nation", "n_nationkey int, n_name string")


@query("artifact_size")
def _(spark, d):
    path = new_path(spark, "artifact")
    writers.json_report(table(spark, d, "nation"), path)
    return synth.artifact_size(spark, path)


@query("gen_baskets")
def _(spark, d):
    return synth.baskets(spark, 2000)


@query("gen_trips")
def _(spark, d):
    return synth.trips(spark, 2000)
