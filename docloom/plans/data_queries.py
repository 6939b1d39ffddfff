"""Registered queries over vectors, logs, joins, sets and incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import hashes, records
from docloom.operators import cells, checks, joins, logs, vectors
from docloom.plans.text_queries import read
from docloom.shared import new_dir
from docloom.sources import jdbc, sinks, versioned
from docloom.streaming import incremental, ledger

def now():
    """The fixed present of the log queries."""
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def unit(i: int) -> list[float]:
    """A fixed query vector of the table's 64 dimensions."""
    return [1.0 if j % 7 == i else 0.0 for j in range(64)]


def shown(df):
    return df.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def vector_topk(spark, sf):
    return shown(vectors.top_k(read(spark, sf, "embeddings"), unit(1), 20))


def vector_topk_filtered(spark, sf):
    """Through the cell index: the nearest cells, then those within reach."""
    return shown(cells.top_k(cells.build(read(spark, sf, "embeddings")), unit(2), 15, (F.col("label") == 3) & (F.col("vec_id") % 5 != 0)))


def vector_topk_merged(spark, sf):
    e = read(spark, sf, "embeddings")
    parts = [vectors.top_k(e, unit(3), 10, F.col("vec_id") % 3 == i) for i in range(3)]
    return shown(vectors.merged(parts, 10))


def vector_nearest(spark, sf):
    """Every vector whose id is divisible by 20, against all vectors, through the cell index."""
    e = read(spark, sf, "embeddings")
    return cells.search(cells.build(e), e.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def snapshot_diff(spark, sf):
    """Documents of ids divisible by 2 or 3 as the stored table, those not divisible by 3 as the snapshot, some with other contents: each document is in one or both."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source")
    stored = d.where("doc_id % 2 = 0 OR doc_id % 3 = 0").select("doc_id", F.col("lang").alias("content"), "source", (F.col("doc_id") % 7 != 0).alias("active"))
    snap = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("content"), F.when(F.col("doc_id") % 11 == 0, "moved").otherwise(F.col("source")).alias("source"))
    return vectors.snapshot_diff(stored, snap, "doc_id", "content", "source").groupBy("change").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("id_sum"))


def index_maintenance(spark, sf):
    """The vector table after a snapshot: what is active, and the vectors, old ones and those of new and changed texts, halves in the last place shown as the even digit."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.md5("text").alias("content_hash"), F.col("lang").alias("metadata"))
    encode = vectors.letter_embedder()
    stored = encode(d.where("chunk_id % 2 = 0 OR chunk_id % 3 = 0")).withColumn("active", F.lit(True))
    snap = d.where("chunk_id % 3 <> 0").withColumn("chunk_text", F.when(F.col("chunk_id") % 5 == 0, F.lower("chunk_text")).otherwise(F.col("chunk_text"))).withColumn("content_hash", F.md5("chunk_text"))
    out = vectors.maintain(stored, snap, encode)
    shown = F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", F.bround(x.cast("double"), 4))), ",")
    return out.select("chunk_id", "content_hash", "active", shown.alias("vector"))


def label_join_left(spark, sf):
    d, q = read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels")
    return joins.with_default(d, q, ["doc_id"], "quality", -1).groupBy("source", "quality").agg(F.count("*").alias("rows"))


def label_semi(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


def label_anti(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def checked_lookup(spark, sf):
    """Orders with their customer's nation: a many-to-one join that fails on a missing or repeated key."""
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    who = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = joins.lookup(joins.lookup(o, who, ["o_custkey"]), n.select("n_nationkey", "n_name"), ["n_nationkey"])
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def overlay_rows(spark, sf):
    """Parts overlaid by names from their brand's least part where these are filled; types keep their own value."""
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    other = p.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("p_name"), F.lit("any").alias("p_type"))
    return joins.overlay(p, other, ["p_partkey"], ["p_name", "p_type"], ["p_type"])


def set_ops(spark, sf):
    d, b = read(spark, sf, "documents").select(F.md5("text").alias("k")), read(spark, sf, "benchmark").select(F.md5("text").alias("k"))
    labelled = read(spark, sf, "labels").select("doc_id").join(read(spark, sf, "documents"), "doc_id").select(F.md5("text").alias("k"))
    parts = {"union": d.union(b).distinct(), "intersect": d.intersect(labelled), "except": d.subtract(labelled), "both": d.intersect(b)}
    out = None
    for name, p in parts.items():
        row = p.agg(F.lit(name).alias("op"), F.count("*").alias("rows"), F.min("k").alias("least"))
        out = row if out is None else out.unionByName(row)
    return out


def keyed_upsert(spark, sf):
    """Labels replaced or added by those of ids divisible by 4, then counted."""
    q = read(spark, sf, "labels")
    new = read(spark, sf, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(7).alias("quality"), F.lit(7).alias("toxic"))
    return sinks.upsert(q, new, ["doc_id"]).groupBy("quality", "toxic").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("id_sum"))


def refresh_column(spark, sf):
    q = read(spark, sf, "labels")
    new = q.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("quality"))
    return sinks.refresh(q, new, ["doc_id"], "quality").select("doc_id", "quality", "toxic", "changed")


def bucketed_upsert(spark, sf):
    """Documents as a table of 32 buckets; some are replaced and some added, and only the buckets of these are rewritten, as the names of the files show."""
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    table = versioned.Versioned(spark, new_dir(spark, "documents"), ["doc_id"], buckets=32)
    table.upsert(d, batch=0)
    some = d.where("doc_id % 250 = 0")
    new = some.withColumn("source", F.lit("replaced")).unionByName(some.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit("added").alias("source"), "n_chars"))
    m = table.upsert(new, batch=1)
    change = {f.split("/")[1] for b, f in m["folders"].items() if int(b) in m["rewritten"]}
    here = F.lit(False)
    for c in change:
        here = here | F.contains(F.input_file_name(), F.lit(c))
    return table.rows().select("doc_id", "source", "n_chars", here.alias("rewritten"))


def change_classes(spark, sf):
    """Pages seen with other hashes: what is new, unchanged, changed on the surface only, or updated."""
    p = read(spark, sf, "pages").select("page_id", F.md5("url").alias("source_hash"), F.md5("html").alias("content_hash"))
    seen = p.where("page_id % 4 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, "x").otherwise(F.col("source_hash")).alias("source_hash"), F.when(F.col("page_id") % 9 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"))
    return incremental.change_class(seen, p, "page_id").groupBy("change").agg(F.count("*").alias("pages"))


def log_recent_topn(spark, sf):
    e = read(spark, sf, "events")
    return logs.recent(e, "ts", "event_id", now(), 7, 100).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type")


def jdbc_recent_topn(spark, sf):
    """As log_recent_topn, from a database: events are put there in a batch, and the database filters, sorts and cuts off. It is Derby in this process, so the session is a local one; elsewhere pass the address of a server to `jdbc.Database`."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("the embedded database is in one process: use a local session, or jdbc.Database with a server's address")
    db = jdbc.Database(spark, f"jdbc:derby:memory:docloom_{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    e = read(spark, sf, "events").select(F.col("event_id").alias("EVENT_ID"), F.col("ts").cast("timestamp").alias("TS"), F.substring("event_type", 1, 40).alias("EVENT_TYPE"))
    db.put(e, "events", "EVENT_ID", 0)
    top = db.newest("events", "TS", "EVENT_ID", 100, "2024-01-24 00:00:00")
    return top.select(F.col("EVENT_ID").alias("event_id"), F.date_format("TS", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("EVENT_TYPE").alias("event_type"))


def log_retention(spark, sf):
    e = read(spark, sf, "events")
    kept = sinks.retained(e.withColumn("created", F.expr("ts - make_interval(0, cast(user_id % 8 as int))")), "created", now(), 4)
    return kept.groupBy("event_type").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"))


def log_state_latest(spark, sf):
    return logs.latest_state(read(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def question_groups(spark, sf):
    """User turns as questions, grouped by their length; groups name ids twice and unknown ones."""
    c = read(spark, sf, "conversations").where("role = 'user'")
    q = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.md5("text").alias("question"), F.col("conv_id").alias("created_at"), F.length("text").alias("n"))
    ids = q.select("id", F.explode(F.array(F.col("n") % 7, F.col("n") % 5)).alias("position")).unionByName(spark.range(5).select(F.lit(-1).cast("long").alias("id"), F.col("id").cast("int").alias("position")))
    out = logs.grouped_questions(ids.select("position", F.concat(F.lit("g"), F.col("position")).alias("label"), "id", F.col("id").alias("place")), q.drop("n"))
    return out.select("label", "questions", F.array_join("examples", ",").alias("examples"))


def nested_rollup(spark, sf):
    e = read(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("cents", F.floor("value"))
    return logs.nested_rollup(e, ["event_type", "day", "user_id"], "cents", F.col("cents").between(0, 50)).select("event_type", "day", "user_id", "rows", "rated", "average", "level")


def nested_tree(spark, sf):
    e = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = logs.nested_tree(e, "r_name", "n_nationkey", F.col("n_name"))
    return out.select("r_name", F.array_join(F.transform(F.map_entries("tree"), lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.array_join(x["value"], "+"))), ",").alias("tree"))


def pending_work(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    tries = read(spark, sf, "events").select((F.col("user_id")).alias("doc_id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("partial").alias("status"))
    return logs.pending(d, tries, read(spark, sf, "labels"), "doc_id", ["done"]).select("doc_id", "status")


def context_rendering(spark, sf):
    e = cells.search(cells.build(read(spark, sf, "embeddings")), read(spark, sf, "embeddings").where("vec_id % 20 = 0"), 3)
    hits = e.join(read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source"), "vec_id").withColumn("kind", F.when(F.col("vec_id") % 2 == 0, "syllabus").otherwise("notice"))
    return logs.rendered_context(hits, "query_id", "rank", "kind", "text", "source").select("query_id", F.length("context").alias("chars"), F.md5("context").alias("context_hash"))


def stream_windowed_counts(spark, sf):
    out = incremental.windowed_counts(read(spark, sf, "events"), "ts", "6 hours", ["event_type"], "value")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def session_windows(spark, sf):
    out = incremental.sessions(read(spark, sf, "events"), "ts", "12 hours", "user_id")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


def unseen_rows(spark, sf):
    """Documents that no label is for, by a ledger of the labels' ids with Bloom bitmaps."""
    book = ledger.Ledger(spark, new_dir(spark, "ledger"), ["doc_id"], buckets=16)
    book.record(read(spark, sf, "labels"), 1)
    return book.unseen(read(spark, sf, "documents").select("doc_id", "source")).groupBy("source").agg(F.count("*").alias("left"))


def sliding_counts(spark, sf):
    """Windows of 12 hours that begin every 4 hours."""
    out = incremental.windowed_counts(read(spark, sf, "events"), "ts", "12 hours", ["event_type"], "value", slide="4 hours")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def until_quota(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return incremental.until_quota(d, "lang", F.col("n_chars") > 1500, ["doc_id"], 10).select("doc_id", "lang")


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_topk_merged, vector_nearest, snapshot_diff, index_maintenance, label_join_left, label_semi, label_anti, checked_lookup, overlay_rows, set_ops, keyed_upsert, refresh_column, bucketed_upsert, change_classes, log_recent_topn, jdbc_recent_topn, log_retention, log_state_latest, question_groups, nested_rollup, nested_tree, pending_work, context_rendering, stream_windowed_counts, session_windows, unseen_rows, sliding_counts, until_quota)}


def top(i: int, k: int, where: str = "true") -> str:
    return f"SELECT vec_id, label, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(0, 64), lambda j: CASE WHEN j % 7 = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS distance FROM embeddings WHERE {where} ORDER BY distance, vec_id LIMIT {k}"


ORACLES = {
    "vector_topk": top(1, 20),
    "vector_topk_filtered": top(2, 15, "label = 3 AND vec_id % 5 <> 0"),
    "vector_topk_merged": top(3, 10),
    "vector_nearest": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank FROM p) SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5""",
    "snapshot_diff": """WITH s AS (SELECT doc_id, lang AS c, source AS m, doc_id % 7 <> 0 AS a FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0),
        n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS c, CASE WHEN doc_id % 11 = 0 THEN 'moved' ELSE source END AS m FROM documents WHERE doc_id % 3 <> 0),
        j AS (SELECT coalesce(s.doc_id, n.doc_id) AS id, CASE WHEN n.doc_id IS NULL THEN CASE WHEN a THEN 'stale' ELSE 'gone' END WHEN s.doc_id IS NULL THEN 'new' WHEN s.c <> n.c THEN 'changed' WHEN s.m <> n.m OR NOT a THEN 'metadata' ELSE 'same' END AS change FROM s FULL JOIN n USING (doc_id))
        SELECT change, count(*) AS rows, CAST(sum(id) AS BIGINT) AS id_sum FROM j GROUP BY 1""",
    "index_maintenance": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN lower(text) ELSE text END AS text, doc_id % 3 <> 0 AS active FROM documents),
        v AS (SELECT *, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE)) AS v FROM r),
        n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v)
        SELECT doc_id AS chunk_id, md5(text) AS content_hash, active, array_to_string(list_transform(v, lambda x: printf('%.4f', CAST(CAST(CASE WHEN size > 0 THEN x / size ELSE 0 END AS FLOAT) AS DOUBLE))), ',') AS vector FROM n""",
    "context_rendering": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p),
        h AS (SELECT query_id, string_agg('[' || rank || '] ' || coalesce(source, 'unknown') || chr(10) || CASE WHEN vec_id % 2 = 0 THEN substr(text, 1, 1200) ELSE text END, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 3 GROUP BY 1)
        SELECT query_id, CAST(length(context) AS INT) AS chars, md5(context) AS context_hash FROM h""",
    "label_join_left": "SELECT source, coalesce(quality, -1) AS quality, count(*) AS rows FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "label_semi": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "label_anti": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "checked_lookup": "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "overlay_rows": "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_name END AS p_name, p_type FROM part",
    "set_ops": """WITH d AS (SELECT md5(text) AS k FROM documents), b AS (SELECT md5(text) AS k FROM benchmark), l AS (SELECT md5(text) AS k FROM labels JOIN documents USING (doc_id))
        SELECT 'union' AS op, count(*) AS rows, min(k) AS least FROM (SELECT k FROM d UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*), min(k) FROM (SELECT k FROM d INTERSECT SELECT k FROM l)
        UNION ALL SELECT 'except', count(*), min(k) FROM (SELECT k FROM d EXCEPT SELECT k FROM l) UNION ALL SELECT 'both', count(*), min(k) FROM (SELECT k FROM d INTERSECT SELECT k FROM b)""",
    "keyed_upsert": """WITH u AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 7, 7 FROM documents WHERE doc_id % 4 = 0)
        SELECT quality, toxic, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM u GROUP BY 1, 2""",
    "refresh_column": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS quality, toxic, doc_id % 3 = 0 AND quality <> 1 AS changed FROM labels",
    "bucketed_upsert": """WITH d AS (SELECT doc_id, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents), u AS (SELECT doc_id, 'replaced' AS source, n_chars FROM d WHERE doc_id % 250 = 0 UNION ALL SELECT doc_id + 1000000000, 'added', n_chars FROM d WHERE doc_id % 250 = 0),
        t AS (SELECT * FROM d WHERE doc_id % 250 <> 0 UNION ALL SELECT * FROM u), b AS (SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 32 AS bucket FROM t)
        SELECT doc_id, source, n_chars, bucket IN (SELECT bucket FROM b WHERE source IN ('replaced', 'added')) AS rewritten FROM b""",
    "change_classes": """SELECT CASE WHEN page_id % 4 = 0 THEN 'new' WHEN page_id % 3 <> 0 THEN 'unchanged' WHEN page_id % 9 <> 0 THEN 'same_content' ELSE 'updated' END AS change, count(*) AS pages FROM pages GROUP BY 1""",
    "log_recent_topn": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-24' ORDER BY events.ts DESC, event_id DESC LIMIT 100",
    "jdbc_recent_topn": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-24' ORDER BY events.ts DESC, event_id DESC LIMIT 100",
    "log_retention": "SELECT event_type, count(*) AS events, min(event_id) AS first_id FROM events WHERE ts - to_months(CAST(user_id % 8 AS INT)) >= TIMESTAMP '2023-09-30' GROUP BY 1",
    "log_state_latest": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type, round(value, 6) AS value FROM r WHERE n = 1",
    "question_groups": """WITH q AS (SELECT conv_id * 100 + turn AS id, md5(text) AS question, conv_id AS asked, length(text) AS n FROM conversations WHERE role = 'user'),
        g AS (SELECT id, question, asked, least(n % 7, n % 5) AS p FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY asked DESC, id DESC) AS k FROM g)
        SELECT 'g' || p AS label, count(*) AS questions, string_agg(question, ',' ORDER BY k) FILTER (WHERE k <= 3) AS examples FROM r GROUP BY p ORDER BY questions DESC, p LIMIT 8""",
    "nested_rollup": """WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id, CASE WHEN floor(value) BETWEEN 0 AND 50 THEN CAST(floor(value) AS BIGINT) END AS v FROM events)
        SELECT event_type, day, user_id, count(*) AS rows, count(v) AS rated, round_even(avg(v), 2) AS average, 3 - grouping(event_type) - grouping(day) - grouping(user_id) AS level FROM e GROUP BY ROLLUP (event_type, day, user_id) HAVING grouping(event_type) = 0""",
    "nested_tree": "SELECT r_name, string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey) AS tree FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "pending_work": """WITH a AS (SELECT user_id AS doc_id, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'partial' END, event_id) AS status FROM events GROUP BY 1)
        SELECT doc_id, status FROM documents LEFT JOIN a USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND coalesce(status, '') NOT IN ('done', 'failed')""",
    "stream_windowed_counts": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_counts": """WITH w AS (SELECT *, unnest(range(0, 3)) AS k FROM events)
        SELECT strftime(time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '2024-01-01') - INTERVAL 1 HOUR * (4 * k), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS first FROM events),
        s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), c AS (SELECT user_id, n, count(*) AS events FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, max(events) AS longest FROM c GROUP BY 1""",
    "unseen_rows": "SELECT source, count(*) AS left FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "until_quota": """WITH n AS (SELECT doc_id, lang, coalesce(sum(CAST(n_chars > 1500 AS INT)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
        SELECT doc_id, lang FROM n WHERE b < 10""",
}


def provider_once(spark, sf):
    """Each different event type asked once of a stand-in provider (the length of what it is asked), answers joined back, scores from 1 to 5 kept."""
    from docloom.operators import hooks

    p = read(spark, sf, "events").select("event_id", "event_type")
    out = hooks.ask_once(p, "event_type", "answer", hooks.with_retries(lambda rows: [str(len(r)) for r in rows]))
    return hooks.scored(out, "answer", "score").groupBy("event_type", "score").agg(F.count("*").alias("events"))


def record_fields(spark, sf):
    """Semesters, credit hours, headers, names and error classes from strings of the order table."""
    r = records

    o = read(spark, sf, "orders").withColumn("n", F.col("o_orderkey") % 4 + 1)
    season = F.when(F.col("n") == 1, "1학기").when(F.col("n") == 2, "여름학기").otherwise("closed")
    said = F.concat(F.lit("20"), F.lpad((F.col("o_orderkey") % 25).cast("string"), 2, "0"), F.lit("년 "), season)
    body = F.concat(F.lit("priority "), "o_orderpriority")
    return o.select(
        "o_orderkey",
        r.semester_of(said).alias("semester"),
        r.credit_hours(F.concat_ws("-", F.col("n"), F.lit(2), F.lit(1)))["credits"].alias("credits"),
        r.with_header(body, [("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority"))]).alias("headed"),
        r.safe_name(F.concat(F.lit(" a/b:"), F.col("o_orderkey").cast("string"), F.lit(". "))).alias("name"),
        r.error_class(F.when(F.col("n") == 1, "Model is LOADING").when(F.col("n") == 2, "bad")).alias("error"),
        r.question_id(F.when(F.col("n") == 3, "own"), F.col("n")).alias("question_id"),
        r.star_rating(F.concat(F.lit("width: "), F.col("n") * 20, F.lit("%"))).alias("stars"),
    )


def blind_labels(spark, sf):
    """The conversations' roles in a hashed order by conversation, labelled A, B, C."""
    from pyspark.sql import Window

    c = read(spark, sf, "conversations").select("conv_id", "role").distinct()
    order = F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), "role", F.lit(":7")))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(order))
    return c.select("conv_id", "role", F.substring(F.lit("ABCD"), n, F.lit(1)).alias("label"))


def seed_spread(spark, sf):
    """Benchmark items as seeded questions, spread evenly over 30 days."""
    b = logs.evenly_spread(read(spark, sf, "benchmark").select("item_id"), ["item_id"], now())
    return b.select("item_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


QUERIES |= {f.__name__: f for f in (provider_once, record_fields, blind_labels, seed_spread)}
ORACLES |= {
    "provider_once": "SELECT event_type, CASE WHEN length(event_type) BETWEEN 1 AND 5 THEN CAST(length(event_type) AS INT) END AS score, count(*) AS events FROM events GROUP BY 1, 2",
    "record_fields": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '20' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') || '-1학기' WHEN 1 THEN '20' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') || '-여름학기' END AS semester,
        CAST(o_orderkey % 4 + 1 AS INT) AS credits, CASE WHEN contains('priority ' || o_orderpriority, o_orderstatus) THEN '' ELSE '[status: ' || o_orderstatus || ']' || chr(10) END || 'priority ' || o_orderpriority AS headed,
        'a_b_' || o_orderkey AS name, CASE o_orderkey % 4 WHEN 0 THEN 503 WHEN 1 THEN 500 END AS error, CASE WHEN o_orderkey % 4 = 2 THEN 'own' ELSE 'Q00' || (o_orderkey % 4 + 1) END AS question_id, CAST(o_orderkey % 4 + 1 AS DOUBLE) AS stars FROM orders""",
    "blind_labels": "SELECT conv_id, role, substr('ABCD', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY md5(conv_id || ':' || role || ':7')) AS INT), 1) AS label FROM (SELECT DISTINCT conv_id, role FROM conversations)",
    "seed_spread": "SELECT item_id, strftime(TIMESTAMP '2024-01-31' - to_hours(CAST(((row_number() OVER (ORDER BY item_id) - 1) * 720) // count(*) OVER () AS INT)), '%Y-%m-%d %H:%M:%S') AS created_at FROM benchmark",
}


def answers_of(spark, sf):
    """Conversations as maps of answers by model (the roles), every seventh assistant failing."""
    c = read(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("text").alias("text"))
    said = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 7 == 0), F.concat(F.lit("[ERROR] "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "role", said.alias("text")).groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "text")))).alias("answers"))


def exploded_answers(spark, sf):
    """Answers by model as rows, failed ones left out, as a response shows them."""
    rows = checks.exploded_answers(answers_of(spark, sf), "answers").where(checks.answered(F.col("answer")))
    shown = checks.shown_sources(F.col("answer"), F.when(F.col("conv_id") % 3 == 0, F.col("model")), F.lit("chat"))
    return rows.select("conv_id", "model", shown.alias("s")).select("conv_id", "model", F.md5("s.content").alias("content_hash"), "s.source", "s.category")


def contract_violations(spark, sf):
    """Documents as review chunks, some of which break the contract: how many break which rule first."""
    d = read(spark, sf, "documents")
    i = F.col("doc_id")
    rows = d.select(
        i.alias("lecture"), F.col("text").alias("chunk_text"), F.when(i % 19 == 0, "notice").otherwise("lecture_review").alias("source_type"),
        F.when(i % 11 == 0, "x1").otherwise(i.cast("string")).alias("lecture_id"), F.concat(F.when(i % 13 == 0, "page:").otherwise("lecture:"), i.cast("string")).alias("chunk_id"),
        F.when(i % 17 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"),
    )
    return checks.violations(rows, checks.review_chunk_rules())


def category_balance(spark, sf):
    """Whether each event type stands once for each user."""
    e = read(spark, sf, "events").select("event_type", "user_id").distinct()
    return checks.balance(e, "event_type", "user_id", 150, ["view", "click", "error", "purchase", "signup", "refund"])


def rater_completeness(spark, sf):
    """Users as raters of days: which days each has left out."""
    e = read(spark, sf, "events").select((F.col("user_id") % 40).alias("rater"), F.date_format("ts", "yyyy-MM-dd HH").alias("unit"))
    return checks.completeness(e, "rater", ["unit"])


def search_states(spark, sf):
    """Users as courses, event types as queries, values as lectures found: candidates, queries and status."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("course"), F.col("event_type").alias("query"), F.floor("value").alias("lecture"), "value")
    found = e.where("value < 2 AND query <> 'error'").select("course", "query", "lecture")
    runs = e.select("course", "query", F.when((F.col("course") % 9 == 0) | (F.col("query") == "error"), "timeout").alias("error"))
    out = checks.search_states(found.where("course % 9 <> 0"), runs, None)
    names = F.array_join(F.transform("candidates", lambda c: F.concat(c["lecture"].cast("string"), F.lit("="), F.array_join(c["found_by"], "+"))), ",")
    return out.select("course", F.coalesce(names, F.lit("")).alias("candidates"), F.array_join("queries", "+").alias("queries"), "status")


def scan_statuses(spark, sf):
    """Orders with what was seen and expected of their lines."""
    o = read(spark, sf, "orders").join(read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("seen")), "o_orderkey")
    expected = F.when(F.col("o_orderkey") % 4 != 0, F.lit(4))
    return o.groupBy(checks.scan_status(F.col("seen"), expected, F.col("o_orderstatus") == "P").alias("status")).agg(F.count("*").alias("orders"), F.sum("seen").alias("lines"))


def department_grid(spark, sf):
    """Parts as courses: those with a code whose department names the target."""
    p = read(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_brand")).alias("code"), "p_type")
    out = checks.grid_rows(p, "code", "p_type", "STEEL")
    return out.select("p_partkey", "code", "department_filter")


def served_models(spark, sf):
    """Priorities as model names asked for: the default where none is asked for, null for those not served."""
    o = read(spark, sf, "orders")
    asked = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    return o.groupBy(checks.resolved_model(asked, "1-URGENT", {"1-URGENT": "base", "2-HIGH": "lora"}).alias("served")).agg(F.count("*").alias("orders"))


def question_texts(spark, sf):
    """A conversation's first user turn with its other user turns as bundled questions."""
    c = read(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = F.transform("t", lambda x: x["text"])
    return c.select("conv_id", F.md5(records.question_text(texts[0], F.slice(texts, 2, 100))).alias("question_hash"))


def fingerprints(spark, sf):
    """Configurations of nations and review fingerprints of customers."""
    n = read(spark, sf, "nation")
    c = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), hashes.config_fingerprint("v1", name=F.col("n_name"), key=F.col("n_nationkey")).alias("fingerprint"))
    r = read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), hashes.review_fingerprint(F.col("c_custkey"), F.col("c_mktsegment"), F.concat("c_name", F.lit(" \n  x "))).alias("fingerprint"))
    return c.unionByName(r)


def casefold_order(spark, sf):
    """Parts' names in order of their lower-case form, then of the name: the first 100."""
    p = read(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return p.orderBy(F.lower("name"), "name", "p_partkey").limit(100)


def chunk_headers(spark, sf):
    """Headers of documents: title, date, attachment, of what is filled."""
    d = read(spark, sf, "documents")
    title, date, file = (F.when(F.col("doc_id") % k != 0, c) for k, c in ((3, F.col("source")), (4, F.lit("2024-01-31")), (2, F.col("lang"))))
    return d.select("doc_id", F.md5(records.chunk_header(title, date, file)).alias("header_hash"))


def fallback_answers(spark, sf):
    """What is said of each user's questions where no answer is generated."""
    e = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").cast("string").alias("first"))
    line = records.group_text(F.col("event_type"), F.col("n"), F.array("first"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum("n").cast("int").alias("n"))
    return g.select("user_id", F.md5(records.fallback_answer(records.period_text(F.lit("2024-01-01"), F.lit("2024-01-31"), F.col("n")), F.col("lines"))).alias("answer_hash"))


def until_empty(spark, sf):
    """Events as rounds of users, of which those of high value produce something: up to three empty rounds in a row."""
    e = read(spark, sf, "events").select("event_id", "user_id", "value")
    return incremental.until_empty(e, "user_id", F.when(F.col("value") > 20, 1).otherwise(0), ["event_id"]).select("event_id", "user_id")


def pages_to_read(spark, sf):
    """Documents as list pages of ten posts, the labelled ones known: what an update run reads."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", F.lit(1).alias("k")), "doc_id", "left")
    pages = d.groupBy((F.floor(F.col("doc_id") / 10) + 1).alias("page")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull() | (F.col("doc_id").between(120, 149)), F.col("doc_id")))).alias("known"))
    out = None
    for mode in ("full", "resume", "update"):
        part = incremental.pages_to_read(pages, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("pages"), F.max("page").alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES |= {f.__name__: f for f in (exploded_answers, contract_violations, category_balance, rater_completeness, search_states, scan_statuses, department_grid, served_models, question_texts, fingerprints, casefold_order, chunk_headers, fallback_answers, until_empty, pages_to_read)}
ORACLES |= {
    "exploded_answers": """WITH a AS (SELECT conv_id, role AS model, CASE WHEN role = 'assistant' AND conv_id % 7 = 0 THEN '[ERROR] ' ELSE '' END || min(text) AS answer FROM conversations GROUP BY conv_id, role)
        SELECT conv_id, model, md5(substr(answer, 1, 200)) AS content_hash, CASE WHEN conv_id % 3 = 0 THEN model ELSE 'unknown' END AS source, 'chat' AS category FROM a WHERE trim(answer, ' ') <> '' AND NOT starts_with(answer, '[ERROR]')""",
    "contract_violations": """SELECT CASE WHEN trim(text, ' ') = '' THEN 'chunk_text' WHEN doc_id % 19 = 0 THEN 'source_type' WHEN doc_id % 11 = 0 THEN 'lecture_id' WHEN doc_id % 13 = 0 THEN 'chunk_id' WHEN doc_id % 17 = 0 THEN 'content_hash' END AS reason, count(*) AS rows FROM documents GROUP BY 1 HAVING reason IS NOT NULL""",
    "category_balance": """WITH e AS (SELECT DISTINCT event_type, user_id FROM events), n AS (SELECT event_type, count(*) AS rows FROM e GROUP BY 1)
        SELECT c AS event_type, coalesce(rows, 0) AS rows, coalesce(rows, 0) AS distinct_keys, coalesce(rows, 0) = 150 AS ok FROM (SELECT unnest(['view', 'click', 'error', 'purchase', 'signup', 'refund']) AS c) LEFT JOIN n ON c = event_type""",
    "rater_completeness": """WITH e AS (SELECT DISTINCT user_id % 40 AS rater, strftime(ts, '%Y-%m-%d %H') AS unit FROM events), t AS (SELECT count(DISTINCT unit) AS expected FROM e)
        SELECT rater, count(*) AS units, any_value(expected) AS expected, any_value(expected) - count(*) AS missing FROM e, t GROUP BY rater""",
    "search_states": """WITH e AS (SELECT user_id AS course, event_type AS query, CAST(floor(value) AS BIGINT) AS lecture, value FROM events),
        f AS (SELECT course, lecture, string_agg(DISTINCT query, '+' ORDER BY query) AS finders FROM e WHERE value < 2 AND query <> 'error' AND course % 9 <> 0 GROUP BY 1, 2),
        c AS (SELECT course, string_agg(lecture || '=' || finders, ',' ORDER BY lecture) AS candidates, count(*) AS n FROM f GROUP BY 1),
        r AS (SELECT course, string_agg(DISTINCT query, '+' ORDER BY query) AS queries, bool_and(course % 9 = 0 OR query = 'error') AS failed FROM e GROUP BY 1)
        SELECT course, coalesce(candidates, '') AS candidates, queries, CASE WHEN failed THEN 'error' WHEN n > 1 THEN 'needs_check' WHEN n = 1 THEN 'candidates_found' ELSE 'no_results' END AS status FROM r LEFT JOIN c USING (course)""",
    "scan_statuses": """WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS seen FROM lineitem GROUP BY 1)
        SELECT CASE WHEN o_orderstatus = 'P' OR (o_orderkey % 4 <> 0 AND seen < 4) THEN 'partial' WHEN o_orderkey % 4 = 0 THEN 'scanned_completeness_unverified' WHEN seen > 4 THEN 'needs_check' ELSE 'complete' END AS status, count(*) AS orders, CAST(sum(seen) AS BIGINT) AS lines FROM orders JOIN l USING (o_orderkey) GROUP BY 1""",
    "department_grid": "SELECT p_partkey, p_brand AS code, 'STEEL' AS department_filter FROM part WHERE p_partkey % 5 <> 0 AND contains(p_type, 'STEEL')",
    "served_models": """SELECT CASE CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END WHEN '1-URGENT' THEN 'base' WHEN '2-HIGH' THEN 'lora' END AS served, count(*) AS orders FROM orders GROUP BY 1""",
    "question_texts": """WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'user')
        SELECT conv_id, md5(string_agg(CASE WHEN n = 1 THEN text ELSE (n - 1) || '. ' || text END, chr(10) ORDER BY n)) AS question_hash FROM c GROUP BY 1""",
    "fingerprints": """SELECT 'n' || n_nationkey AS id, sha256('v1:{"key":' || n_nationkey || ',"name":' || to_json(n_name) || '}') AS fingerprint FROM nation
        UNION ALL SELECT 'c' || c_custkey, sha256(c_custkey || chr(10) || c_mktsegment || chr(10) || c_name || ' x') FROM customer""",
    "casefold_order": "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part) SELECT * FROM p ORDER BY lower(name), name, p_partkey LIMIT 100",
    "chunk_headers": """SELECT doc_id, md5(concat_ws(chr(10), 'title: ' || CASE WHEN doc_id % 3 <> 0 THEN source ELSE '(제목 없음)' END, CASE WHEN doc_id % 4 <> 0 THEN 'date: 2024-01-31' END, CASE WHEN doc_id % 2 <> 0 THEN 'attachment: ' || lang END)) AS header_hash FROM documents""",
    "fallback_answers": """WITH e AS (SELECT user_id, '- ' || event_type || ' (' || count(*) || '): ' || min(event_id) AS line, count(*) AS n FROM events GROUP BY user_id, event_type)
        SELECT user_id, md5('2024-01-01 to 2024-01-31, ' || CAST(sum(n) AS BIGINT) || ' questions' || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS answer_hash FROM e GROUP BY 1""",
    "until_empty": """WITH n AS (SELECT event_id, user_id, value > 20 AS made, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        w AS (SELECT *, sum(CAST(NOT made AS INT)) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS e FROM n), s AS (SELECT user_id, min(n) AS stop FROM w WHERE e = 3 AND n >= 3 GROUP BY 1)
        SELECT event_id, user_id FROM n LEFT JOIN s USING (user_id) WHERE stop IS NULL OR n <= stop""",
    "pages_to_read": """WITH d AS (SELECT doc_id, doc_id // 10 + 1 AS page, doc_id IN (SELECT doc_id FROM labels) OR doc_id BETWEEN 120 AND 149 AS k FROM documents), p AS (SELECT page, bool_and(k) AS every FROM d GROUP BY 1),
        s AS (SELECT min(a.page) AS stop FROM p a JOIN p b ON a.page = b.page + 1 WHERE a.every AND b.every AND b.page >= 2)
        SELECT 'full' AS mode, count(*) AS pages, max(page) AS last FROM p UNION ALL SELECT 'resume', count(*), max(page) FROM p WHERE NOT every UNION ALL SELECT 'update', count(*), max(page) FROM p, s WHERE stop IS NULL OR page <= stop""",
}
