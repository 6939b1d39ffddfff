"""Question logs: state by latest event, retention, groups of questions, nested rollups, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import ordered
from docloom.shared import unused


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: an append-only log read as a table."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def recent(log: DataFrame, created: str, key: str, now: Column, days: int | None, limit: int) -> DataFrame:
    """The newest rows, of so many days or of all that is kept: a top-n."""
    rows = log if days is None else log.where(F.col(created) >= now - F.make_interval(days=F.lit(days)))
    return rows.orderBy(F.desc(created), F.desc(key)).limit(limit)


def question_groups(groups: DataFrame, questions: DataFrame, examples: int = 3, most: int = 8) -> DataFrame:
    """(label, questions, examples) from proposed groups (position, label, question_ids) and known questions (id, question, created_at).

    Unknown ids are left out, an id counts in the first group that names it, counts are made here; groups by count, then
    position; examples newest first.
    """
    return grouped_questions(groups.select("position", "label", F.posexplode("question_ids").alias("place", "id")), questions, examples, most)


def grouped_questions(named: DataFrame, questions: DataFrame, examples: int = 3, most: int = 8) -> DataFrame:
    """question_groups from rows (position, label, id, place) in place of arrays, for groups of any size."""
    once = named.groupBy("id").agg(F.min_by(F.struct("position", "label"), F.struct("position", "place")).alias("g")).select("id", "g.*")
    known = once.join(questions, "id")
    # the newest of a group are the newest of its parts' newest, so that no task holds a whole group
    part = known.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    newest = Window.orderBy(F.desc("created_at"), F.desc("id"))
    best = part.withColumn("_at", F.row_number().over(newest.partitionBy("position", "label", "_part"))).where(F.col("_at") <= examples)
    shown = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id", "question")))), 1, examples), lambda x: x["question"])
    counts = known.groupBy("position", "label").agg(F.count("*").alias("questions"))
    out = counts.join(best.groupBy("position", "label").agg(shown.alias("examples")), ["position", "label"])
    return out.orderBy(F.desc("questions"), "position").limit(most).select("label", "questions", "examples")


def nested_rollup(df: DataFrame, levels: list[str], value: str, valid: Column) -> DataFrame:
    """levels, rows, valid rows and their mean (two decimals), for every prefix of levels: one ROLLUP; the full total is left out."""
    own = df.select(*levels, F.when(valid, F.col(value)).alias("_v"))
    rows = own.rollup(*levels).agg(F.grouping_id().alias("_g"), F.count("*").alias("rows"), F.count("_v").alias("rated"), F.bround(F.avg("_v"), 2).alias("average"))
    depth = len(levels)
    return rows.where(F.col("_g") < (1 << depth) - 1).withColumn("level", sum((F.col("_g").bitwiseAND(F.lit(1 << i)) == 0).cast("int") for i in range(depth))).drop("_g")


def nested_tree(df: DataFrame, outer: str, inner: str, leaf: Column) -> DataFrame:
    """(outer, map of inner to its leaves), leaves in order."""
    per = df.groupBy(outer, inner).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    return per.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "leaves")))).alias("tree"))


def course_groups(candidates: DataFrame, order: list[str], name: str = "course_name", code: str = "course_code", professor: str = "professor", lecture: str = "lecture_id") -> DataFrame:
    """(course_key, course_name, course_codes, professors): courses by their normalised name (white space and case apart), the name and each lecture as they stand first in the order.

    `professors` maps a professor (`unnamed` where there is none) to the lectures (structs of the other columns) of that
    group, each lecture id once. Codes, professors and lectures are in the order of their first rows. Blank names are left
    out. Each level is one aggregation of the one below, so that repeated rows are folded where they are.
    """
    key = F.lower(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"(?U)\s+", ""))
    rows = candidates.select(key.alias("course_key"), F.trim(name).alias("_name"), F.col(code).alias("_code"), F.coalesce(F.nullif(F.trim(professor), F.lit("")), F.lit("unnamed")).alias("_who"), F.col(lecture).alias("_id"), F.struct(*order).alias("_at"), F.struct(*(c for c in candidates.columns if c not in (name, code, professor))).alias("_row"))
    rows = rows.where("course_key <> ''")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda x: x[c])
    names = rows.groupBy("course_key").agg(F.min_by("_name", "_at").alias("course_name"))
    codes = rows.where("_code IS NOT NULL").groupBy("course_key", "_code").agg(F.min("_at").alias("_at")).groupBy("course_key").agg(listed("_code").alias("course_codes"))
    once = rows.where("_id IS NOT NULL").groupBy("course_key", "_who", "_id").agg(F.min_by("_row", "_at").alias("_row"), F.min("_at").alias("_at"))
    per = once.groupBy("course_key", "_who").agg(listed("_row").alias("_rows"), F.min("_at").alias("_at"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_who", "_rows"))), lambda x: F.struct(x["_who"], x["_rows"]))
    people = per.groupBy("course_key").agg(F.map_from_entries(entries).alias("professors"))
    return names.join(codes, "course_key", "left").join(people, "course_key", "left")


def pending(lectures: DataFrame, attempts: DataFrame, saved: DataFrame, key: str, done: list[str], retry_failed: bool = False) -> DataFrame:
    """Lectures that are neither saved nor done by their last attempt; failed ones again only if asked."""
    last = latest_state(attempts, key, ["attempt"]).select(key, "status")
    left = lectures.join(saved.select(key).distinct(), key, "left_anti").join(last, key, "left")
    finished = F.coalesce(F.col("status").isin(done), F.lit(False))
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    return left.where(~finished & (~failed | F.lit(retry_failed)))


def rendered_context(hits: DataFrame, group: str, rank: str, source_type: str, text: str, title: str, cut: int = 1200) -> DataFrame:
    """(group, context): hits in order of rank, each under its number and title, syllabus texts cut."""
    shown = F.when(F.col(source_type) == "syllabus", F.substring(text, 1, cut)).otherwise(F.col(text))
    part = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.coalesce(F.col(title), F.lit("unknown")), F.lit("\n"), shown)
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("p"))))
    return hits.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("context"))


def evenly_spread(rows: DataFrame, order: list[str], now: Column, days: int = 30) -> DataFrame:
    """rows with `created_at` spread over the last days, by hours, in order."""
    before, every = unused(rows, "_before", "_every")
    placed = ordered.running(rows, [], order, F.lit(1), before, total=every)
    hours = F.floor(F.col(before) * (days * 24) / F.col(every)).cast("int")
    return placed.withColumn("created_at", now - F.make_interval(hours=hours)).drop(before, every)
