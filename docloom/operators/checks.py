"""Contracts of rows and tables: rules with reasons, verified hashes, expectations on counts, filters and projections of answers, states of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, null for none; a rule that is null is broken."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, rows): how many rows break each rule first."""
    return df.select(reason(rules).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("rows"))


def require(df: DataFrame, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """df; reading a row that breaks a rule fails and names its key and the rule."""
    broken = reason(rules)
    said = F.concat_ws(" ", F.lit("contract broken by"), F.col(key).cast("string"), broken)
    return df.where(F.when(broken.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows) of each key; reading one that stands twice fails."""
    per = df.groupBy(*key).agg(F.count("*").alias("rows"))
    said = F.concat_ws(" ", F.lit("not unique:"), *(F.col(k).cast("string") for k in key))
    return per.where(F.when(F.col("rows") > 1, F.raise_error(said).cast("boolean")).otherwise(True))


def hash_rule(text: str = "chunk_text", digest: str = "content_hash") -> tuple[str, Column]:
    """The stored hash is that of the text, made again."""
    return "content_hash", F.col(digest) == F.sha2(F.col(text), 256)


def review_chunk_rules(source_type: str = "lecture_review", prefix: str = "lecture:") -> list[tuple[str, Column]]:
    """What a chunk of a review must be: filled text, right source type, digits as lecture id, an id of that prefix, a verified hash."""
    return [
        ("chunk_text", F.trim("chunk_text") != ""),
        ("source_type", F.col("source_type") == source_type),
        ("lecture_id", F.col("lecture_id").rlike(r"^[0-9]+$")),
        ("chunk_id", F.col("chunk_id").startswith(prefix)),
        hash_rule(),
    ]


def balance(df: DataFrame, category: str, key: str, rows_each: int, expected: list[str] | None = None) -> DataFrame:
    """(category, rows, distinct_keys, ok): whether each category has so many rows, each key once; categories that are missing have none."""
    found = df.groupBy(category).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_keys"))
    if expected:
        found = df.sparkSession.createDataFrame([(e,) for e in expected], f"{category} string").join(found, category, "left").fillna(0, ["rows", "distinct_keys"])
    return found.withColumn("ok", (F.col("rows") == rows_each) & (F.col("distinct_keys") == rows_each))


def completeness(ratings: DataFrame, rater: str, unit: list[str]) -> DataFrame:
    """(rater, units, expected, missing): what each rater has rated of all units that anyone has."""
    per = ratings.select(rater, *unit).distinct().groupBy(rater).agg(F.count("*").alias("units"))
    every = ratings.select(*unit).distinct().agg(F.count("*").alias("expected"))
    return per.join(F.broadcast(every)).withColumn("missing", F.col("expected") - F.col("units"))


def answered(answer: Column, mark: str = "[ERROR]") -> Column:
    """Neither missing, blank nor an error."""
    return F.coalesce((F.trim(answer) != "") & ~answer.startswith(mark), F.lit(False))


def exploded_answers(df: DataFrame, answers: str, model: str = "model", answer: str = "answer") -> DataFrame:
    """A row for each entry of a map of answers by model."""
    return df.select(*(c for c in df.columns if c != answers), F.explode(answers).alias(model, answer))


def shown_sources(content: Column, url: Column, category: Column, most: int = 200) -> Column:
    """What a response shows of a hit: the start of its content, where it is from, its category."""
    return F.struct(F.substring(content, 1, most).alias("content"), F.coalesce(F.nullif(F.trim(url), F.lit("")), F.lit("unknown")).alias("source"), category.alias("category"))


def search_states(found: DataFrame, searched: DataFrame, before: DataFrame | None = None, key: str = "course") -> DataFrame:
    """(key, candidates, queries, status) from hits (key, query, lecture) and searches (key, query, error).

    Candidates are the different lectures of all queries with the queries that found them. The status is error where every
    search failed, else needs_check for several candidates, candidates_found for one, no_results for none; where it is
    error, the candidates of `before` (key, candidates) stay.
    """
    per = found.groupBy(key, "lecture").agg(F.array_sort(F.collect_set("query")).alias("found_by"))
    each = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lecture", "found_by"))).alias("candidates"))
    runs = searched.groupBy(key).agg(F.array_sort(F.collect_set("query")).alias("queries"), F.min(F.col("error").isNotNull()).alias("failed"))
    out = runs.join(each, key, "left")
    if before is not None:
        out = out.join(before.select(key, F.col("candidates").alias("_before")), key, "left").withColumn("candidates", F.when(F.col("failed"), F.coalesce("_before", "candidates")).otherwise(F.col("candidates"))).drop("_before")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    status = F.when(F.col("failed"), "error").when(n > 1, "needs_check").when(n == 1, "candidates_found").otherwise("no_results")
    return out.select(key, "candidates", "queries", status.alias("status"))


def scan_status(seen: Column, expected: Column, stopped: Column) -> Column:
    """partial where a scan was stopped or saw less than is known to be there, unverified where nothing is known, needs_check where it saw more."""
    return F.when(stopped | (seen < expected), "partial").when(expected.isNull(), "scanned_completeness_unverified").when(seen > expected, "needs_check").otherwise("complete")


def grid_rows(df: DataFrame, code: str, department: str, target: str) -> DataFrame:
    """Rows with a code whose department names the target, tagged with it."""
    return df.where((F.trim(F.coalesce(code, F.lit(""))) != "") & F.contains(F.col(department), F.lit(target))).withColumn("department_filter", F.lit(target))


def resolved_model(asked: Column, default: str, known: dict[str, str]) -> Column:
    """The served name of the model asked for, else of the default; null where it is not served. `known` maps names to served ones."""
    name = F.coalesce(F.nullif(F.trim(asked), F.lit("")), F.lit(default))
    return F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), name)


#: Conditions of an evaluation and the serving mode of each (fixed values are the caller's; these are the usual four).
MODES = {"base": "base", "base_rag": "rag", "lora": "lora", "lora_rag": "lora_rag"}


def missing_models(served: DataFrame, conditions: list[str], modes: dict[str, str] | None = None, name: str = "model") -> DataFrame:
    """(condition, mode) of the conditions whose mode no row of `served` names, blanks and case apart; a condition without a mode fails the job."""
    modes = MODES if modes is None else modes
    unknown = [c for c in conditions if c not in modes]
    if unknown:
        raise ValueError(f"no serving mode for {', '.join(unknown)}")
    wanted = served.sparkSession.createDataFrame([(c, modes[c]) for c in conditions], "condition string, mode string")
    there = served.select(F.lower(F.trim(name)).alias("mode")).distinct()
    return wanted.join(there, F.lower(wanted["mode"]) == there["mode"], "left_anti")


def require_models(served: DataFrame, conditions: list[str], modes: dict[str, str] | None = None, name: str = "model") -> None:
    """Refuses an evaluation of which a model is not served."""
    missing = [r["condition"] for r in missing_models(served, conditions, modes, name).collect()]
    if missing:
        raise ValueError(f"not served: {', '.join(sorted(missing))}")
