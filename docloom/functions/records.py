"""Fields of course, review and attachment records: semesters, labelled values, names, titles, renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English semester names and what they are called here (fixed values).
SEMESTERS = {"spring": "1학기", "fall": "2학기", "autumn": "2학기", "summer": "여름학기", "winter": "겨울학기", "first": "1학기"}


def semester_of(text: Column) -> Column:
    """`yyyy-n` from texts such as 24년 1학기, 2024-1학기 or 2024 spring; null where there is none."""
    year = F.regexp_extract(text, r"(?:20)?(\d{2})\s*(?:년|[-/.])", 1)
    season = F.regexp_extract(text, r"(여름|겨울|계절|[12])\s*학기", 1)
    english = F.lower(F.regexp_extract(text, r"(?i)\b(spring|fall|autumn|summer|winter)\b", 1))
    numbered = F.regexp_extract(text, r"(?i)(?:20)?(\d{2})\s+(?:spring|fall|autumn|summer|winter)", 1)
    y = F.coalesce(F.nullif(year, F.lit("")), F.nullif(numbered, F.lit("")))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in SEMESTERS.items() for x in kv)), english)
    return F.when(y.isNotNull() & ((season != "") | named.isNotNull()), F.concat(F.lit("20"), y, F.lit("-"), F.when(season != "", F.concat(season, F.lit("학기"))).otherwise(named)))


def star_rating(style: Column) -> Column:
    """A bar's width in per cent as a rating of five."""
    width = F.regexp_extract(style, r"width:\s*(\d+(?:\.\d+)?)%", 1).try_cast("double")
    return F.when(width.between(0, 100), F.round(width / 20, 4))


def labelled(text: Column, *labels: str) -> Column:
    """What follows the first of these labels on its own line; null where there is nothing."""
    found = [F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{label}[ \t]*[:：][ \t]*(\S.*)$", 1)), F.lit("")) for label in labels]
    return F.coalesce(*found)


def credit_hours(text: Column) -> Column:
    """struct of credits, lecture and practice hours from a-b-c."""
    p = r"\b(\d+)-(\d+)-(\d+)\b"
    part = lambda i: F.regexp_extract(text, p, i).try_cast("int")
    return F.when(text.rlike(p), F.struct(part(1).alias("credits"), part(2).alias("lecture"), part(3).alias("practice")))


#: The labels of a syllabus's fields, English and Korean (fixed values).
SYLLABUS = {
    "course_name": ("Course Title", "교과목명"),
    "course_code": ("Course Code", "교과목코드"),
    "professor": ("Professor", "담당교수"),
    "department": ("Department", "개설학과"),
    "grade": ("Grade", "학년"),
    "credits": ("Credits", "학점"),
    "lecture_time": ("Time", "강의시간"),
    "semester": ("Semester", "학기"),
    "category": ("Category", "이수구분"),
    "contact": ("E-mail", "연락처"),
}


def syllabus_fields(text: Column, labels: dict[str, tuple[str, ...]] = SYLLABUS) -> Column:
    """struct of the fields of a free text, null where missing: credits as a-b-c become three numbers, a room in brackets after the time its own field."""
    found = {name: labelled(text, *names) for name, names in labels.items()}
    hours = credit_hours(found["credits"])
    room = F.nullif(F.regexp_extract(found["lecture_time"], r"\(([^()]*)\)\s*$", 1), F.lit(""))
    own = {**found, "credits": hours["credits"], "lecture_hours": hours["lecture"], "practice_hours": hours["practice"], "room": room}
    own["lecture_time"] = F.trim(F.regexp_replace(found["lecture_time"], r"\s*\([^()]*\)\s*$", ""))
    return F.struct(*(c.alias(name) for name, c in own.items()))


def chunk_header(title: Column, date: Column, attachment: Column, none: str = "(제목 없음)") -> Column:
    """The lines above each chunk: title, date and attachment, of what is filled."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    line = lambda label, c: F.when(filled(c).isNotNull(), F.concat(F.lit(f"{label}: "), filled(c)))
    return F.concat_ws("\n", F.concat(F.lit("title: "), F.coalesce(filled(title), F.lit(none))), line("date", date), line("attachment", attachment))


def question_text(question: Column, bundled: Column) -> Column:
    """The question with the numbered questions that it bundles (an array), if any."""
    lines = F.transform(F.filter(bundled, lambda q: F.trim(q) != ""), lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q))
    return F.when(F.size(lines) > 0, F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))).otherwise(question)


def group_text(label: Column, n: Column, examples: Column) -> Column:
    """A line for a group of questions."""
    return F.concat(F.lit("- "), label, F.lit(" ("), n.cast("string"), F.lit("): "), F.array_join(examples, "; "))


def fallback_answer(period: Column, groups: Column) -> Column:
    """What is said where no answer is generated: the period and a line for each group (an array)."""
    return F.when(F.size(groups) > 0, F.concat(period, F.lit("\n"), F.array_join(groups, "\n"))).otherwise(F.concat(period, F.lit("\nno questions")))


def safe_name(name: Column, most: int = 120) -> Column:
    """A file name without characters that file systems refuse."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|\x00-\x1F]+', "_"), r"^[\s.]+|[\s.]+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, most), F.lit("")), F.lit("file"))


def disposition_name(header: Column) -> Column:
    """The file name of a content-disposition header, encoded or plain."""
    encoded = F.regexp_extract(header, r"(?i)filename\*\s*=\s*[\w-]+''([^;]+)", 1)
    plain = F.regexp_extract(header, r'(?i)filename\s*=\s*"?([^";]+)"?', 1)
    return F.when(encoded != "", F.try_url_decode(encoded)).when(plain != "", F.trim(plain))


def extension(name: Column, url: Column, content_type: Column, kinds: dict[str, str]) -> Column:
    """From the name, else the URL's path, else the content type."""
    of = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"(\.[A-Za-z0-9]{1,5})$", 1)), F.lit(""))
    by_type = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.lower(F.split(content_type, ";")[0]))
    return F.coalesce(of(name), of(F.regexp_extract(url, r"\A[^?#]*", 0)), by_type, F.lit(""))


def first_date(candidates: list[Column], parse) -> Column:
    """The first candidate text that holds a date."""
    return F.coalesce(*map(parse, candidates))


def text_body(fields: list[Column], every: Column, least: int = 20) -> Column:
    """The first field that is not blank, else all longer values of the record (a map) by lines."""
    filled = [F.nullif(F.trim(c), F.lit("")) for c in fields]
    others = F.array_join(F.filter(F.map_values(every), lambda v: F.length(v) > least), "\n")
    return F.coalesce(*filled, F.nullif(others, F.lit("")))


def with_header(body: Column, facts: list[tuple[str, Column]]) -> Column:
    """body under `[k: v | k: v]` of the facts that it does not hold itself."""
    parts = F.array_compact(F.array(*(F.when((F.trim(v) != "") & ~F.contains(body, F.trim(v)), F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in facts)))
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, " | "), F.lit("]\n"), body)).otherwise(body)


def period_text(first: Column, last: Column, n: Column) -> Column:
    return F.format_string("%s to %s, %d questions", first, last, n)


def error_class(message: Column, cold: tuple[str, ...] = ("loading", "starting", "timed out", "connection refused")) -> Column:
    """503 for a model that is still starting, 500 for anything else."""
    hit = F.lit(False)
    for c in cold:
        hit = hit | F.contains(F.lower(message), F.lit(c))
    return F.when(message.isNull(), None).when(hit, 503).otherwise(500)


def question_id(given: Column, position: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.format_string("Q%03d", position))
