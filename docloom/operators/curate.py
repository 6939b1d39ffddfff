"""Curation of question and answer rows: filters, drop reasons, one per document, hashed sampling, quotas, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import body_of, share_of, spaced_key
from docloom.operators import ordered
from docloom.shared import unused

#: The script that a record must mostly have (fixed value of the reference corpus), a parameter everywhere.
HANGUL = "[가-힣]"
#: Marks of crawled states that are no content (fixed value).
JUNK = "scanned_|completeness|unverified|리뷰 요소 없음|수집을 시도|로딩 지연|화면 변경 여부"


def good_chunk(text: Column, flags: Column, source_type: Column, date: Column, since: str, script: str = HANGUL, least: int = 150, least_script: float = 0.4, most_digits: float = 0.3) -> Column:
    """Not flagged, not OCR, not older than `since` (dates as strings; unknown ones count as older), with enough body, script and few digits."""
    body = body_of(text)
    clean = ~F.array_contains(flags, "fragmented_lines") & ~F.array_contains(flags, "ocr_review_recommended")
    fresh = F.coalesce(date, F.lit("")) >= since
    return clean & (source_type != "image_ocr") & fresh & (F.length(body) >= least) & (share_of(body, script) >= least_script) & (share_of(body, "[0-9]") <= most_digits)


def not_before(date: Column, floor: str) -> Column:
    """The date (a string such as 2024-01-31) is the floor or later; unknown ones, null or blank, are kept."""
    return F.coalesce(F.trim(date), F.lit("")).isin("") | (F.trim(date) >= floor)


def long_enough(text: Column, least: int = 10) -> Column:
    """At least so many characters without blanks at the ends."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= least


def good_pair(question: Column, answer: Column, script: str = HANGUL) -> Column:
    q, a = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    return F.length(q).between(8, 200) & F.length(a).between(20, 1000) & (share_of(a, script) >= 0.3)


def valid_record(text: Column, category: Column, no_data: str = "조회된 데이터가 없습니다", letters: str = "[가-힣a-zA-Z]", enders: str = "(니다|세요|해요|[.!?])") -> Column:
    """Long enough, with letters; of syllabi without repeated no-data marks, of notices no menu path and some sentences."""
    enough = (F.length(text) >= 30) & (F.regexp_count(text, F.lit(letters)) >= 15)
    syllabus = F.regexp_count(text, F.lit(no_data)) < 2
    notice = (F.regexp_count(text, F.lit(" > ")) < 2) & (F.regexp_count(text, F.lit(enders)) >= 2)
    return enough & F.when(category == "syllabi", syllabus).when(category == "notices", notice).otherwise(True)


def drop_reasons(df: DataFrame, question: str, answer: str, order: list[str], least_question: int = 5, least_answer: int = 30, junk: str = JUNK) -> DataFrame:
    """df with `drop_reason`: malformed, too_short, crawl_status, duplicate (of an earlier kept question) or kept."""
    q, a = F.trim(question), F.trim(answer)
    early = (
        F.when(F.col(question).isNull() | F.col(answer).isNull(), "malformed")
        .when((F.length(q) < least_question) | (F.length(a) < least_answer), "too_short")
        .when(q.rlike(junk) | a.rlike(junk), "crawl_status")
    )
    marked = df.withColumn("_early", early).withColumn("_key", spaced_key(F.col(question)))
    first = marked.where("_early IS NULL").groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    joined = marked.join(first, "_key", "left")
    again = F.when(F.struct(*order) != F.col("_first"), "duplicate").otherwise("kept")
    return joined.withColumn("drop_reason", F.coalesce("_early", again)).drop("_early", "_key", "_first")


def best_per_group(df: DataFrame, good: Column, group: list[str], order: list[str]) -> DataFrame:
    """The first good row of each group: one aggregation."""
    rest = [c for c in df.columns if c not in group]
    return df.where(good).groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*group, "_r.*")


def hashed_order(key: Column, seed: str) -> Column:
    """A fixed shuffle: the order of a hash of key and seed, the same in every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in a fixed shuffled order: a top-n, so no full sort."""
    return df.withColumn("shuffle_key", hashed_order(F.col(key), seed)).orderBy("shuffle_key", key).limit(n)


def batches(df: DataFrame, group: list[str], order: list[str], text: str, size: int, separator: str = "\n---\n") -> DataFrame:
    """So many consecutive rows of a group as one, joined; the last may be shorter."""
    (n,) = unused(df, "_n")
    placed = ordered.numbered(df, group, order, n).withColumn("batch", F.floor((F.col(n) - 1) / size).cast("long"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), F.col(text).alias("text")))), lambda x: x["text"])
    return placed.groupBy(*group, "batch").agg(F.count("*").alias("rows"), F.array_join(texts, separator).alias("batch_text"))


def interleaved(df: DataFrame, category: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """Categories in turns, each up to its quota: `turn` and the category's `position`, which replace columns of these names, give the order."""
    names = list(quotas)
    place = F.array_position(F.array(*map(F.lit, names)), F.col(category)).cast("int")
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(category))
    (n,) = unused(df, "_n")
    rows = ordered.numbered(df.where(F.col(category).isin(names)), [category], order, n).where(F.col(n) <= limit)
    return rows.select(*(c for c in df.columns if c not in ("turn", "position")), F.col(n).cast("int").alias("turn"), place.alias("position"))
