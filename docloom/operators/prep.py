"""Keyed de-duplication, quality flags, fan-out and preparation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import ordered

REPLACEMENT = "�"


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, with `first_seen` (the key's first place) and `copies`: one aggregation, partial on the map side."""
    rest = [c for c in df.columns if c not in key]
    place = F.struct(*order)
    out = df.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("_r"), F.min(place).alias("first_seen"), F.count("*").alias("copies"))
    return out.select(*key, "_r.*", "first_seen", "copies")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("copies"))
    return out.select(*key, "_r.*", "copies")


def longest_wins(df: DataFrame, key: list[str], text: str, order: list[str]) -> DataFrame:
    """The row with the longest text of each key; of equally long ones the later."""
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.length(text), *order)).alias("_r"), F.count("*").alias("copies"))
    return out.select(*key, "_r.*", "copies")


def conflicts(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before them with the same key."""
    return ordered.previous(df, key, order, value, "previous").where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def disagreements(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, values, rows): keys that stand with several values, whatever the order of rows."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("values"), F.count("*").alias("rows")).where(F.col("values") > 1)


def quality_flags(text: Column, ocr: Column | None = None, least_lines: int = 10, short: int = 3, most_short: float = 0.3) -> Column:
    """array of ocr_review_recommended, replacement_character, fragmented_lines where they hold."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    few = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= short))
    broken = (F.size(lines) >= least_lines) & (few / F.size(lines) > most_short)
    flags = [F.when(ocr, "ocr_review_recommended")] if ocr is not None else []
    flags += [F.when(F.contains(text, F.lit(REPLACEMENT)), "replacement_character"), F.when(broken, "fragmented_lines")]
    return F.array_compact(F.array(*flags))


def field_flags(fields: dict[str, Column], identified: Column) -> Column:
    """missing_or_invalid_<field> for each null, and content_based_identity."""
    flags = [F.when(c.isNull(), f"missing_or_invalid_{n}") for n, c in fields.items()]
    return F.array_compact(F.array(*flags, F.when(~identified, "content_based_identity")))


def fan_out(notices: DataFrame, post: str = "post_id", blank: bool = False) -> DataFrame:
    """A row for the body, the OCR text and each attachment of a notice that has text: (post_id, source_key, source_type, name, text).

    Attachments are numbered by reference within their notice: attachment:{ref}:{n}. With `blank` bodies and attachments
    without text have rows and numbers too; an OCR text without text never has.
    """
    kind = "struct<source_type:string,ref:string,name:string,text:string>"
    none = F.lit(None).cast("string")
    part = lambda t, ref, name, text: F.struct(F.lit(t).alias("source_type"), ref.alias("ref"), name.alias("name"), text.alias("text")).cast(kind)
    attached = F.transform(F.coalesce("attachments", F.array().cast("array<struct<url:string,name:string,text:string>>")), lambda a: part("attachment", F.coalesce(F.nullif(a["url"], F.lit("")), a["name"]), a["name"], a["text"]))
    parts = F.concat(F.array(part("body", none, none, F.col("content")), part("image_ocr", none, none, F.col("ocr_text"))), attached)
    said = F.trim(F.coalesce("text", F.lit(""))) != ""
    rows = notices.select(post, F.posexplode(parts).alias("pos", "p")).select(post, "pos", "p.*").where(said | (F.col("source_type") != "image_ocr") if blank else said)
    n = F.row_number().over(Window.partitionBy(post, "source_type", "ref").orderBy("pos"))
    key = F.when(F.col("source_type") == "attachment", F.concat_ws(":", F.lit("attachment"), F.coalesce("ref", F.lit("")), n)).otherwise(F.col("source_type"))
    return rows.select(post, key.alias("source_key"), "source_type", "name", "text")


def course_key(year: Column, semester: Column, code: Column) -> Column:
    """struct of year, semester and upper-case code, unknown where missing; null without a code."""
    filled = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    return F.when(F.trim(F.coalesce(code, F.lit(""))) != "", F.struct(filled(year).alias("year"), filled(semester).alias("semester"), F.upper(F.trim(code)).alias("code")))


def labelled_text(facts: list[tuple[str, Column]], sections: list[tuple[str, Column]], fallback: Column) -> Column:
    """`label: value` lines of what is filled, then sections under their heads; the fallback where all sections are empty."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    lines = [F.when(filled(c), F.concat(F.lit(f"{k}: "), c)) for k, c in facts]
    parts = F.array_compact(F.array(*(F.when(filled(c), F.concat(F.lit(f"[{k}]\n"), c)) for k, c in sections)))
    body = F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.coalesce(fallback, F.lit("")))
    return F.concat_ws("\n", *lines, F.nullif(body, F.lit("")))


def report(df: DataFrame, group: list[str], text: str, date: str | None = None, flags: str | None = None, known_flags: list[str] | None = None, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Rows, least, greatest and mean length (one decimal), sum of lengths, different texts, by group: one aggregation.

    With `date` (strings) first_date and last_date over those that are not blank; with `flags` (an array) flag_<name> for each
    of `known_flags` and flagged rows; with `conditions` the rows for which each holds. Null texts count as rows only.
    """
    n = F.length(text)
    parts = [F.count("*").alias("rows"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.bround(F.avg(n), 1).alias("avg_chars"), F.sum(n).alias("total_chars"), F.countDistinct(text).alias("distinct_texts")]
    if date is not None:
        filled = F.nullif(F.trim(date), F.lit(""))
        parts += [F.min(filled).alias("first_date"), F.max(filled).alias("last_date")]
    if flags is not None:
        parts += [F.count_if(F.array_contains(flags, f)).alias(f"flag_{f}") for f in known_flags or []]
        parts.append(F.count_if(F.size(flags) > 0).alias("flagged"))
    parts += [F.count_if(c).alias(name) for name, c in (conditions or {}).items()]
    return df.groupBy(*group).agg(*parts)


def select_courses(courses: DataFrame, selected: list[str] | None = None, include_other: bool = False, code: str = "course_code", major: str = "is_major") -> DataFrame:
    """Major courses, or all, of the selected codes, each once; a selected code that is not there fails the job."""
    rows = courses if include_other else courses.where(F.col(major))
    rows = rows.dropDuplicates([code])
    if not selected:
        return rows
    wanted = courses.sparkSession.createDataFrame([(c,) for c in selected], f"{code} string")
    found = wanted.join(rows, code, "left")
    missing = F.raise_error(F.concat(F.lit("not among the courses: "), F.col(code))).cast("boolean")
    return found.where(F.when(F.col(major).isNull(), missing).otherwise(True))


def repair(items: DataFrame, attachments: str, extract, rehash) -> DataFrame:
    """items whose blank PDF texts are read again: `extract` is a Column function of an attachment, `rehash` of the repaired array.

    Only items with such an attachment are touched; `repaired` counts the texts that were won.
    """
    blank = lambda a: F.lower(a["name"]).endswith(".pdf") & (F.trim(F.coalesce(a["text"], F.lit(""))) == "")
    todo = items.where(F.exists(attachments, blank))
    fixed = F.transform(F.col(attachments), lambda a: F.when(blank(a), a.withField("text", F.coalesce(extract(a), F.lit("")))).otherwise(a))
    won = F.size(F.filter(F.arrays_zip(F.col("_new"), F.col(attachments)), lambda z: blank(z[attachments]) & (F.trim(z["_new"]["text"]) != "")))
    out = todo.withColumn("_new", fixed).withColumn("repaired", won).withColumn("content_hash", rehash(F.col("_new")))
    return out.withColumn(attachments, F.col("_new")).drop("_new")
