"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a hashed order, pass after pass. A copy's virtual finish time is its source's words up to
and with it, divided by the source's target; all copies are sorted by finish time over the whole table, in ranges, and the
mix is cut off where the budget of words is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, running_total, table, written

#: Passes at most, rows in a bucket of a source's order and in a range of the global order (about; ranges at most), seed.
PASSES, BUCKET_ROWS, MOST_RANGES, SEED = 3, 4096, 1_000_000, "mix-1"
#: Sources (about 300 bytes each) whose cuts may be sent to every task.
BROADCAST_SOURCES = 20_000


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size): shares of all words by weight, none above `passes` times its source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. What a capped source cannot take is shared by weight among
    the others, which is one water level: with sources by rising cap per weight, the first level (words left / weights
    left) that does not exceed its source's own cap per weight. The windows hold one row for each source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = sizes.withColumn("rank", F.row_number().over(by_name).cast("long"))
    w = w.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * passes)
    w = w.withColumn("per_weight", F.col("cap") / F.col("weight"))
    order = Window.orderBy("per_weight", "rank")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("per_weight", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("left", F.sum("source_size").over(everything) - (F.sum("cap").over(up_to) - F.col("cap")))
    w = w.withColumn("weights_left", F.sum("weight").over(everything) - (F.sum("weight").over(up_to) - F.col("weight")))
    w = w.withColumn("place", F.row_number().over(order)).withColumn("level", F.col("left") / F.col("weights_left"))
    fits = F.when(F.col("level") <= F.col("per_weight"), F.struct("place", "level"))
    w = w.withColumn("water", F.min(fits).over(everything))
    target = F.when(F.col("place") < F.col("water.place"), F.col("cap").cast("double")).otherwise(F.col("water.level") * F.col("weight"))
    return w.select("source", "source_size", "rank", target.alias("target"))


def shuffle_key(id_col: str) -> Column:
    """The place of an id in the order of its source."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + SEED)))


def queue(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """A row for each pass over each document: doc_id, source, size, key, rows, copy, turn, source_size, target and `taken`, 1 before the cut.

    Equal rows (same id, source and size) are counted as one item up to the queue, where each of them, told by `copy` from 1
    on, stands on its own, one after another. Only ids, sources and sizes are shuffled, and words are counted once.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"))
    items = narrow.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).withColumn("units", F.col("size") * F.col("rows"))
    items = written(items, "items")
    much = items.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    ranges = max(1024, min(MOST_RANGES, -(-(much["rows"] or 0) * passes // BUCKET_ROWS)))
    per = items.groupBy("source").agg(F.sum("units").alias("source_size"), F.count("*").alias("_items"))
    goal = targets(per.select("source", "source_size"), passes).withColumnRenamed("source", "_s")
    per = per.select(F.col("source").alias("_t"), "_items").join(goal, F.col("_t").eqNullSafe(F.col("_s"))).drop("_t")
    key = shuffle_key("doc_id")
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / float(1 << 32)
    placed = items.join(per, items["source"].eqNullSafe(per["_s"])).drop("_s").withColumn("key", key)
    placed = placed.withColumn("bucket", F.floor(share * F.ceil(F.col("_items") / BUCKET_ROWS)))
    order = [F.asc("key"), F.asc("doc_id"), F.asc("size")]
    queued = running_total(placed, ["source"], "bucket", order, "units", "done")
    # an item of very many rows is dealt out in parts before it becomes rows
    parts = queued.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / BUCKET_ROWS).cast("int"))))
    if (much["most"] or 0) > BUCKET_ROWS:
        parts = parts.repartition("key", "size", "part")
    span = F.sequence(F.col("part") * BUCKET_ROWS + 1, F.least(F.col("rows"), (F.col("part") + 1) * BUCKET_ROWS).cast("int"))
    each = parts.withColumn("copy", F.explode(span)).withColumn("done", F.col("done") - F.col("units") + F.col("copy") * F.col("size"))
    turns = each.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).where("source_size > 0 or turn = 0")
    finish = F.coalesce(F.try_divide(F.col("turn") * F.col("source_size") + F.col("done"), "target"), F.lit(0.0))
    turns = turns.withColumn("finish", finish).withColumn("range", F.floor(F.col("finish") / (1 + F.col("finish")) * ranges))
    total = items.agg(F.sum("units").alias("budget"))
    line = running_total(turns, [], "range", [F.asc("finish"), F.asc("rank"), *order, F.asc("turn"), F.asc("copy")], "size", "served")
    kept = line.join(F.broadcast(total)).withColumn("taken", (F.col("served") <= F.col("budget")).cast("long"))
    return kept


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """(doc_id, source, size, copy, copies, source_size, target), a row for each document: how often the mix takes it.

    Null texts have no words; documents of sources without words are taken once, with 0 words. Null ids and sources are
    values like any other; an empty table gives no rows.
    """
    kept = queue(docs, id_col, source_col, text_col, passes)
    return kept.groupBy("doc_id", "source", "size", "copy", "source_size", "target").agg(F.sum("taken").alias("copies"))


def cuts(docs: DataFrame) -> DataFrame:
    """(source, cut0, cut1, ...): the last document that each pass over a source takes, as its place in the source's order, its copy and how many rows are equal to it; null where a pass takes none.

    A source's documents finish in their order, so that whatever stands before such a place is taken too.
    """
    last = F.struct(F.struct("key", "doc_id", "size").alias("place"), "copy", "rows")
    taken = queue(docs).where("taken = 1")
    return taken.groupBy("source").agg(F.count("*").alias("weight"), *(F.max(F.when(F.col("turn") == t, last)).alias(f"cut{t}") for t in range(PASSES)))


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes each: none, one or more equal rows; columns, whatever their names, stay.

    Texts stay where they are: a source's cuts tell of a document how often it is taken, and those of BROADCAST_SOURCES
    sources at most, the largest, are sent to it; documents of other sources are joined with theirs. Null texts have no
    words and are kept once where their source has none, else as often as its passes take them; null ids and sources are
    values like any other; documents of equal finish time go by source, then hash of the id; of rows with the same id,
    source and size each is taken by itself, so some may be taken once more than others, which ones being left open; an
    empty table gives an empty table.
    """
    names = [f"cut{t}" for t in range(PASSES)]
    ends = written(cuts(docs).withColumnRenamed("source", "of"), "cuts")
    place = F.struct(F.col("key"), F.col("doc_id"), F.col("size"))
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", words("text").alias("size"), shuffle_key("doc_id").alias("key")).withColumn("place", place)
    own = lambda e: rows["source"].eqNullSafe(e["of"])
    if ends.count() <= BROADCAST_SOURCES:
        found = rows.join(F.broadcast(ends), own(ends))
    else:
        large = written(ends.orderBy(F.desc("weight"), "of").limit(BROADCAST_SOURCES), "large")
        small = ends.join(large.select(F.col("of").alias("_l")), F.col("of").eqNullSafe(F.col("_l")), "left_anti")
        found = rows.join(F.broadcast(large), own(large)).unionByName(rows.join(F.broadcast(large), own(large), "left_anti").join(small, own(small)))
    at, inside = lambda n: F.col("place") == F.col(f"{n}.place"), lambda n: F.col("place") < F.col(f"{n}.place")
    split = lambda n: F.coalesce(at(n) & (F.col(f"{n}.copy") < F.col(f"{n}.rows")), F.lit(False))
    whole = lambda n: F.coalesce(inside(n) | (at(n) & (F.col(f"{n}.copy") == F.col(f"{n}.rows"))), F.lit(False)).cast("int")
    some = F.lit(False)
    for n in names:
        some = some | split(n)
    found = found.withColumn("each", sum((whole(n) for n in names), F.lit(0))).withColumn("some", some)
    out = found.where("NOT some").select("doc", "each")
    if not ends.where(" OR ".join(f"{n}.copy < {n}.rows" for n in names)).isEmpty():
        # the rows of an item within which a cut falls are numbered in two levels, since they may be a large share of all
        part = found.where("some").select("doc", "doc_id", "of", "size", "place", "each", *names, F.lit(1).alias("one"), F.spark_partition_id().alias("bucket"), F.monotonically_increasing_id().alias("turn"))
        numbered = running_total(written(part, "repeated"), ["doc_id", "of", "size"], "bucket", [F.asc("turn")], "one", "number")
        more = sum(((split(n) & (F.col("number") <= F.col(f"{n}.copy"))).cast("int") for n in names), F.col("each"))
        out = out.unionByName(numbered.select("doc", more.alias("each")))
    return out.where("each > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("each")))).select("doc.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1') AS key
  FROM documents
), d AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM t
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source
), w AS (
  SELECT *, (rk - 1) % 3 + 1 AS weight, source_size * 3 AS cap,
         CAST(source_size * 3 AS DOUBLE) / CAST((rk - 1) % 3 + 1 AS DOUBLE) AS per_weight
  FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY per_weight, rk) AS place,
         CAST((SELECT sum(source_size) FROM s) - (sum(cap) OVER (ORDER BY per_weight, rk) - cap) AS DOUBLE)
         / CAST((SELECT sum(weight) FROM w) - (sum(weight) OVER (ORDER BY per_weight, rk) - weight) AS DOUBLE) AS lvl
  FROM w
), f AS (SELECT place, lvl FROM o WHERE lvl <= per_weight ORDER BY place LIMIT 1
), g AS (
  SELECT o.source, o.source_size, o.rk, CASE WHEN o.place < f.place THEN CAST(o.cap AS DOUBLE) ELSE f.lvl * o.weight END AS target FROM o, f
), q AS (
  SELECT d.*, g.source_size, g.rk, g.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size, d.copy ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT q.*, r.turn, CASE WHEN target = 0 THEN 0.0 ELSE CAST(r.turn * source_size + done AS DOUBLE) / target END AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS turn) r WHERE q.source_size > 0 OR r.turn = 0
), l AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rk, key, doc_id NULLS FIRST, size, turn, copy ROWS UNBOUNDED PRECEDING) AS served FROM c
)
SELECT doc_id, size, source_size, target,
       CAST(size * count(*) FILTER (WHERE served <= (SELECT sum(size) FROM d)) AS BIGINT) AS taken
FROM l GROUP BY doc_id, source, size, copy, source_size, target
"""
