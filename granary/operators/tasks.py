"""A task list as snapshots: views, orders, and changes that give a new snapshot.

tasks(id, title, notes, priority, due_date, tags array, completed boolean, position, created_at, updated_at, completed_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.store import numbered

PRIORITIES = ("high", "medium", "low")
NO_DATE = "9999"
MAX_TAGS, MAX_TAG = 8, 24


def tags_from_json(text: Column) -> Column:
    """A JSON array of strings; what doesn't parse is no tags."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def clean_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, distinct, not blank, cut to MAX_TAG characters, MAX_TAGS at most."""
    low = F.transform(tags, lambda t: F.substring(F.lower(F.trim(t)), 1, MAX_TAG))
    return F.slice(F.array_distinct(F.filter(low, lambda t: t != "")), 1, MAX_TAGS)


def view(tasks: DataFrame, name: str, today: str) -> DataFrame:
    """all, today (open, due by today), upcoming (open, due later), completed. Dates compare as text."""
    due = F.col("due_date")
    conditions = {"all": F.lit(True), "today": ~F.col("completed") & due.isNotNull() & (due <= today), "upcoming": ~F.col("completed") & due.isNotNull() & (due > today), "completed": F.col("completed")}
    return tasks.where(conditions[name])


def search(tasks: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of title, notes or a tag."""
    low = text.lower()
    return tasks.where(F.lower("title").contains(low) | F.lower(F.coalesce("notes", F.lit(""))).contains(low) | F.exists("tags", lambda t: F.lower(t).contains(low)))


def sort_keys(mode: str) -> list[Column]:
    """manual, due (no date last), priority (high first) or created (newest first); ties by id."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    keys = {"manual": [F.col("completed").asc(), F.col("position").asc(), F.col("created_at").desc()], "due": [F.coalesce("due_date", F.lit(NO_DATE)).asc()], "priority": [rank.asc()], "created": [F.col("created_at").desc()]}
    return [*keys[mode], F.col("id").asc()]


def places(tasks: DataFrame, mode: str) -> DataFrame:
    """id and place, from 1, of every task in a mode's order: ranges are sorted apart and shifted by the counts before them."""
    keys = sort_keys(mode)
    slim = tasks.select("id", "completed", "position", "created_at", "due_date", "priority")
    return numbered(slim, keys, "place").select("id", "place")


def counts(tasks: DataFrame, today: str) -> DataFrame:
    open_, due = ~F.col("completed"), F.col("due_date")
    return tasks.agg(F.count_if(open_).alias("open"), F.count_if(open_ & (due <= today)).alias("today"), F.count_if(open_ & (due > today)).alias("upcoming"), F.count_if("completed").alias("completed"), F.round(100 * F.count_if("completed") / F.greatest(F.count("*"), F.lit(1)), 6).alias("progress"))


def next_position(tasks: DataFrame) -> DataFrame:
    return tasks.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("position"))


def insert(tasks: DataFrame, drafts: DataFrame, now: str) -> DataFrame:
    """drafts(id, title, and any of notes, priority, due_date, tags) at the end, in the order of their ids."""
    from pyspark.sql import Window as W

    has = set(drafts.columns)
    pick = lambda c, default: F.coalesce(F.col(c), default) if c in has else default
    x = drafts.crossJoin(F.broadcast(next_position(tasks).withColumnRenamed("position", "_p")))
    x = x.withColumn("position", F.col("_p") + F.row_number().over(W.orderBy("id")) - 1)  # a request's few drafts
    kinds = dict(tasks.dtypes)
    values = {
        "id": F.col("id"), "title": F.trim("title"), "notes": pick("notes", F.lit("")), "priority": pick("priority", F.lit("medium")), "due_date": F.col("due_date") if "due_date" in has else F.lit(None),
        "tags": clean_tags(pick("tags", F.array().cast("array<string>"))), "completed": F.lit(False), "position": F.col("position"), "created_at": F.lit(now), "updated_at": F.lit(now), "completed_at": F.lit(None),
    }
    return tasks.unionByName(x.select(*[values[c].cast(kinds[c]).alias(c) for c in tasks.columns]))


def update(tasks: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """patches(id, title, notes, priority, tags, completed: null keeps; due_date with has_due_date: null clears). A task that stays completed keeps its completed_at; reopening clears it."""
    names = ["title", "notes", "priority", "tags", "completed"]
    p = patches.select(F.col("id"), F.lit(True).alias("_hit"), "has_due_date", F.col("due_date").alias("_due"), *[F.col(c).alias(f"_{c}") for c in names])
    x = tasks.join(p, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    done = F.coalesce("_completed", "completed")
    new = {c: F.coalesce(f"_{c}", c) for c in names}
    new["due_date"] = F.when(hit & F.coalesce("has_due_date", F.lit(False)), F.col("_due")).otherwise(F.col("due_date"))
    new["completed_at"] = F.when(~hit, F.col("completed_at")).when(done, F.coalesce("completed_at", F.lit(now)))
    new["updated_at"] = F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))
    return x.select(*[new.get(c, F.col(c)).alias(c) for c in tasks.columns])


def delete(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("id"), "id", "left_anti")


def bulk_complete(tasks: DataFrame, ids: DataFrame, completed: bool, now: str) -> DataFrame:
    """Unlike a single update this overwrites completed_at."""
    x = tasks.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {"completed": F.when(hit, F.lit(completed)).otherwise(F.col("completed")), "completed_at": F.when(hit, F.lit(now if completed else None).cast("string")).otherwise(F.col("completed_at")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    return x.select(*[new.get(c, F.col(c)).alias(c) for c in tasks.columns])


def reorder(tasks: DataFrame, ids: list[int]) -> DataFrame:
    """Position is the place in the list; unlisted tasks keep theirs."""
    place = tasks.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, _at long")
    x = tasks.join(F.broadcast(place), "id", "left")  # one request's ids
    return x.select(*[F.coalesce("_at", "position").alias(c) if c == "position" else F.col(c) for c in tasks.columns])


def seed_once(tasks: DataFrame, meta: DataFrame, seed: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Seed rows come in only where meta(key, value) lacks the version's marker, and only ids that are new."""
    mark = seed.sparkSession.createDataFrame([(f"seed_{version}", "1")], "key string, value string")
    missing = mark.join(meta, "key", "left_anti")
    rows = seed.join(tasks.select("id"), "id", "left_anti").crossJoin(F.broadcast(missing.select("key"))).drop("key")
    return tasks.unionByName(rows.select(*tasks.columns)), meta.unionByName(missing)


def rules() -> dict[str, Column]:
    return {"id": F.col("id").isNotNull(), "title": F.length("title").between(1, 140), "priority": F.col("priority").isin(*PRIORITIES), "completed_at": F.col("completed") | F.col("completed_at").isNull()}


def date_label(day: Column, today: str) -> Column:
    d, t = F.to_date(day), F.lit(today).cast("date")
    return F.when(d == t, "Today").when(d == F.date_add(t, 1), "Tomorrow").otherwise(F.date_format(d, "yyyy-MM-dd"))
