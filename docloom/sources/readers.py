"""Readers of JSON Lines: strict (the first bad row fails the job) and quarantining (good rows, rejects with reasons)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): 1-based numbers of the lines in each file, from the files as they are split.

    Rows of one file split keep their order; lines are numbered by counting what precedes in smaller splits, so no
    window holds a whole file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\\A\ufeff", "").alias("value"))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    inner = raw.withColumn("inner", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return inner.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("inner")).alias("line"), "value")


def checked(lines: DataFrame, schema: T.StructType, rules: list[tuple[str, Column]]) -> DataFrame:
    """lines with `row` and `reject_reason`: invalid_json, not_object, or the first rule that holds; blank lines are dropped.

    Rules are over the columns of `row` and the parsed variant `v`.
    """
    parsed = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    typed = parsed.withColumn("row", F.from_json("value", schema))
    reason = F.when(F.col("v").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_object")
    for name, holds in rules:
        reason = reason.when(holds, name)
    return typed.withColumn("reject_reason", reason)


def quarantine(checked_lines: DataFrame, examples: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows with their file and line, counts of rejects by reason, first examples of rejects)."""
    good = checked_lines.where("reject_reason IS NULL").select("file", "line", "row.*")
    bad = checked_lines.where("reject_reason IS NOT NULL")
    return good, bad.groupBy("reject_reason").agg(F.count("*").alias("rows")), bad.select("file", "line", "reject_reason").orderBy("file", "line").limit(examples)


def strict(checked_lines: DataFrame) -> DataFrame:
    """The rows; reading a bad one fails and names its file, line and reason."""
    said = F.concat_ws(" ", F.lit("bad row:"), "file", F.col("line").cast("string"), "reject_reason")
    return checked_lines.where(F.when(F.col("reject_reason").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).select("file", "line", "row.*")


def lenient(spark: SparkSession, path: str, schema: T.StructType, defaults: dict) -> DataFrame:
    """Rows that parse, with defaults for what they lack."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return rows.select(*(F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in rows.columns))


def by_file_name(spark: SparkSession, path: str, categories: dict[str, str], pattern: str = "*.jsonl") -> DataFrame:
    """Lines of all files below path, with a category by a part of the file's name; files of none are left out."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    name = F.col("_metadata.file_name")
    category = F.lit(None).cast("string")
    for part, kind in reversed(categories.items()):
        category = F.when(name.contains(part), kind).otherwise(category)
    return lines.select("value", name.alias("file_name"), category.alias("category")).where("category IS NOT NULL")


def ratings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rating rows of all CSV files in path; a rater without a name has the file's."""
    names = "question_id string, blind_label string, rater_id string, accuracy string, response_type string, notes string"
    rows = spark.read.schema(names).csv(path, header=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    rows = rows.select("*", stem.alias("_stem"))
    rows = rows.withColumn("rater_id", F.coalesce(F.nullif(F.trim("rater_id"), F.lit("")), "_stem")).drop("_stem")
    typed = rows.withColumn("accuracy", F.col("accuracy").try_cast("double").try_cast("int")).withColumn("response_type", F.col("response_type").try_cast("double").try_cast("int"))
    ok = F.coalesce(F.col("accuracy").between(1, 5) & F.col("response_type").between(1, 4), F.lit(False))
    return typed.where(ok), typed.where(~ok)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of files that hold one JSON array each, however it is laid out; a file that is no such array fails the job."""
    rows = spark.read.schema(f"{schema.rstrip(', ')}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.raise_error(F.concat(F.lit("no JSON array: "), F.substring("_bad", 1, 80))).cast("boolean")
    return rows.where(F.when(F.col("_bad").isNotNull(), bad).otherwise(True)).drop("_bad")
