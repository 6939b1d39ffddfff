"""Registered queries that write the given tables in the sources' formats, well and badly formed, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text
from docloom.operators import prep
from docloom.plans.text_queries import read
from docloom.shared import new_dir
from docloom.sources import readers, sinks

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def lines(spark, sf, bad: bool) -> str:
    """A folder of JSON Lines of the documents; of the ids that end in 3 to 6 broken, no object, without source and blank, if `bad`."""
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_chars").cast("long").alias("n_chars"))
    n = F.col("doc_id") % 10
    whole = F.to_json(F.struct("doc_id", "source", "n_chars"))
    value = F.when(n == 3, F.substring(whole, 1, 9)).when(n == 4, F.concat(F.lit("["), "doc_id", F.lit("]"))).when(n == 5, F.to_json(F.struct("doc_id", "n_chars"))).when(n == 6, "  ").otherwise(whole) if bad else whole
    path = new_dir(spark, "lines")
    d.select(value.alias("value")).write.text(path)
    return path


def jsonl_quarantine(spark, sf):
    """Good lines and rejects by reason; lines are numbered in their files, each file's from 1 on without gaps but for blank lines."""
    checked = readers.checked(readers.numbered_lines(spark, lines(spark, sf, True)), ROW, [("missing_source", F.col("row.source").isNull())])
    good, reasons, _ = readers.quarantine(checked)
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("rows")).unionByName(reasons.select(F.col("reject_reason").alias("kind"), "rows"))


def jsonl_strict(spark, sf):
    """Well-formed lines read strictly, and by source; every line has its own number."""
    rows = readers.strict(readers.checked(readers.numbered_lines(spark, lines(spark, sf, False)), ROW, [("missing_source", F.col("row.source").isNull())]))
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("id_sum"), F.countDistinct("file", "line").alias("places"))


def jsonl_lenient(spark, sf):
    """Lines that parse, with a default for what they lack."""
    rows = readers.lenient(spark, lines(spark, sf, True), ROW, {"source": F.lit("none")})
    return rows.where("doc_id IS NOT NULL").groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


def csv_ratings(spark, sf):
    """Events as sheets of ratings: valid and rejected rows by rater, those without a name under their file's."""
    e = read(spark, sf, "events")
    n = F.col("event_id")
    sheet = e.select(
        F.concat(F.lit("Q"), n % 30).alias("question_id"), F.lit("A").alias("blind_label"), F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("r"), (n % 3).cast("string"))).alias("rater_id"),
        F.when(n % 11 == 0, "x").otherwise((n % 7).cast("string")).alias("accuracy"), F.concat((n % 5).cast("string"), F.lit(".0")).alias("response_type"), F.col("event_type").alias("notes"),
    )
    path = new_dir(spark, "ratings")
    sheet.write.csv(path, header=True)
    valid, rejected = readers.ratings(spark, path)
    both = valid.withColumn("ok", F.lit(True)).unionByName(rejected.withColumn("ok", F.lit(False)))
    rater = F.when(F.col("rater_id").startswith("part-"), "file").otherwise(F.col("rater_id"))
    return both.groupBy(rater.alias("rater"), "ok").agg(F.count("*").alias("rows"), F.sum("accuracy").alias("accuracy"))


def sink_round_trips(spark, sf):
    """Labels written anew, added to, replaced, as CSV with decimals, as a report, copied from a legacy table, and read back."""
    q = read(spark, sf, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    path, sheet, report = (new_dir(spark, n) for n in ("labels", "sheet", "report"))
    sinks.check_paths(path, sheet, report)
    out = None

    def seen(step, df):
        nonlocal out
        part = df.agg(F.lit(step).alias("step"), F.count("*").alias("rows"), F.sum("doc_id").cast("long").alias("id_sum"), F.sum("quality").cast("double").alias("quality"))
        part = spark.createDataFrame(part.collect(), part.schema)  # one row, before the next step changes the files
        out = part if out is None else out.unionByName(part)

    back = lambda: spark.read.schema("doc_id long, quality long").json(path)
    sinks.write_new(q, path)
    seen("new", back())
    sinks.append(q.where("doc_id % 2 = 0"), path)
    seen("appended", back())
    with sinks.single_writer(spark, path):
        sinks.write_new(q.where("quality = 1"), path, overwrite=True)
    seen("replaced", back())
    sinks.write_csv(q.select("doc_id", (F.col("quality") / 3).alias("quality")), sheet)
    seen("sheet", spark.read.csv(sheet, header=True).toDF("doc_id", "quality").select(F.col("doc_id").cast("long"), F.col("quality").cast("double")))
    sinks.write_report(q.agg(F.count("*").alias("doc_id"), F.sum("quality").alias("quality")), report)
    seen("report", spark.read.schema("doc_id long, quality long").json(report))
    sinks.truncate(spark, path)
    empty = q.limit(0).withColumn("status", F.lit(""))
    seen("legacy", sinks.copy_legacy(empty, q.where("doc_id % 3 = 0")).where("status = 'legacy'"))
    return out


def field_checks(spark, sf):
    """Flags of missing fields, scalars of JSON as text, and titles equal under folding, by event type."""
    e = read(spark, sf, "events")
    v = F.parse_json(F.when(F.col("event_id") % 5 == 0, '{"k": [1]}').when(F.col("event_id") % 5 == 1, '{"k": " a  b "}').when(F.col("event_id") % 5 == 2, '{"k": null}').otherwise(F.col("props")))
    scalar = text.scalar_text(F.try_variant_get(v, "$.k", "variant"))
    flags = prep.field_flags({"rating": F.when(F.col("value") < 50, F.col("value")), "user": F.nullif(F.col("user_id") % 7, F.lit(0))}, F.col("event_id") % 2 == 0)
    title = F.concat(F.initcap("event_type"), F.lit(" ﬁ "), F.col("user_id").cast("string"))
    same = text.nfkc_folded(title) == text.nfkc_folded(F.concat(F.upper("event_type"), F.lit("FI　"), (F.col("user_id") - F.col("event_id") % 2).cast("string")))
    return e.select("event_id", F.array_join(flags, ",").alias("flags"), scalar.alias("scalar"), same.alias("same_title"))


QUERIES = {f.__name__: f for f in (jsonl_quarantine, jsonl_strict, jsonl_lenient, csv_ratings, sink_round_trips, field_checks)}

ORACLES = {
    "jsonl_quarantine": "SELECT CASE doc_id % 10 WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'not_object' WHEN 5 THEN 'missing_source' ELSE 'good' END AS kind, count(*) AS rows FROM documents WHERE doc_id % 10 <> 6 GROUP BY 1",
    "jsonl_strict": "SELECT source, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS id_sum, count(*) AS places FROM documents GROUP BY 1",
    "jsonl_lenient": "SELECT CASE WHEN doc_id % 10 = 5 THEN 'none' ELSE source END AS source, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 10 NOT IN (3, 4, 6) GROUP BY 1",
    "csv_ratings": """WITH e AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'file' ELSE 'r' || (event_id % 3) END AS rater, CASE WHEN event_id % 11 <> 0 THEN event_id % 7 END AS a, event_id % 5 AS t FROM events)
        SELECT rater, coalesce(a BETWEEN 1 AND 5 AND t BETWEEN 1 AND 4, false) AS ok, count(*) AS rows, CAST(sum(a) AS BIGINT) AS accuracy FROM e GROUP BY 1, 2""",
    "sink_round_trips": """WITH s AS (SELECT 'new' AS step, doc_id, CAST(quality AS DOUBLE) AS quality FROM labels UNION ALL SELECT 'appended', doc_id, quality FROM labels UNION ALL SELECT 'appended', doc_id, quality FROM labels WHERE doc_id % 2 = 0
        UNION ALL SELECT 'replaced', doc_id, quality FROM labels WHERE quality = 1 UNION ALL SELECT 'sheet', doc_id, round(quality / 3, 4) FROM labels UNION ALL SELECT 'report', count(*), sum(quality) FROM labels UNION ALL SELECT 'legacy', doc_id, quality FROM labels WHERE doc_id % 3 = 0)
        SELECT step, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS id_sum, sum(quality) AS quality FROM s GROUP BY 1""",
    "field_checks": """SELECT event_id, array_to_string(list_filter([CASE WHEN coalesce(value < 50, false) THEN NULL ELSE 'missing_or_invalid_rating' END, CASE WHEN user_id % 7 = 0 THEN 'missing_or_invalid_user' END, CASE WHEN event_id % 2 = 1 THEN 'content_based_identity' END], lambda x: x IS NOT NULL), ',') AS flags,
        CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a b' WHEN 2 THEN '' ELSE json_extract_string(props, '$.k') END AS scalar, event_id % 2 = 0 AS same_title FROM events""",
}
