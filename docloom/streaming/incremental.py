"""Incremental operators: change classes against stored hashes, upserts by micro-batch, request states, windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators import ordered
from docloom.shared import unused
from docloom.sources.versioned import Versioned


def change_class(seen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """now with `change`: new, unchanged (the cheap hash is equal, nothing was extracted), same_content or updated."""
    old = seen.select(key, F.col("source_hash").alias("_s"), F.col("content_hash").alias("_c"))
    joined = now.join(old, key, "left")
    change = F.when(F.col("_s").isNull(), "new").when(F.col("_s") == F.col("source_hash"), "unchanged").when(F.col("_c") == F.col("content_hash"), "same_content").otherwise("updated")
    return joined.withColumn("change", change).drop("_s", "_c")


def upsert_stream(stream: DataFrame, table: Versioned, order: list[str], checkpoint: str):
    """Keeps the last row of each key by `order`, whatever batch it comes in, in a bucketed and versioned table.

    A batch rewrites the buckets of its keys only; one that is run again changes nothing.
    """
    fold = lambda batch, number: table.upsert(batch, order, number) and None
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_states(events: DataFrame, key: str = "id") -> DataFrame:
    """(id, status, changes) of pending, answered and failed requests, as they change; a finished request stays as it is."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, changes = state.get if state.exists else ("pending", 0)
        rows = pd.concat(list(parts)).sort_values("at")
        for s in rows["status"]:
            if status == "pending" and s in ("answered", "failed"):
                status, changes = s, changes + 1
        state.update((status, changes))
        yield pd.DataFrame({key: [k[0]], "status": [status], "changes": [changes]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, status string, changes long", "status string, changes long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, length: str, group: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling window, or sliding ones where `slide` is less than the length; on a stream, rows later than `late` are left out."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(F.window(at, length, slide).alias("w"), *group).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *group, "events", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    """Sessions of each key, ended by a gap."""
    out = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def unseen(df: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key no earlier run has done."""
    return df.join(ledger.select(*key).distinct(), key, "left_anti")


def until_quota(df: DataFrame, category: str, passed: Column, order: list[str], quota: int) -> DataFrame:
    """Rows of each category up to the one with which so many have passed."""
    (done,) = unused(df, "_done")
    rows = ordered.running(df, [category], order, passed.cast("int"), done)
    return rows.where(F.col(done) < quota).drop(done)


def until_empty(df: DataFrame, category: str, produced: Column, order: list[str], empties: int = 3) -> DataFrame:
    """Rows (rounds) of each category up to the last of so many rounds in a row that produced nothing."""
    some, n, made, first, long, stop = unused(df, "_some", "_n", "_made", "_first", "_long", "_stop")
    rows = ordered.numbered(df.withColumn(some, F.coalesce(produced > 0, F.lit(False))), [category], order, n)
    # a round's stretch is told by how many rounds before it produced something; its place in it, by the row number
    rows = ordered.running(rows, [category], order, F.col(some).cast("int"), made)
    stretch = rows.where(~F.col(some)).groupBy(category, made).agg(F.min(n).alias(first), F.count("*").alias(long))
    last = stretch.where(F.col(long) >= empties).groupBy(category).agg((F.min(first) + empties - 1).alias(stop))
    kept = rows.join(last, category, "left").where(F.col(stop).isNull() | (F.col(n) <= F.col(stop)))
    return kept.select(*df.columns)


def pages_to_read(pages: DataFrame, mode: str, known_pages: int = 2, from_page: int = 2) -> DataFrame:
    """Pages (page, ids, known) that a run reads: all in full mode, those with unknown ids in resume mode, and in update mode up to the second page in a row, from page 2 on, on which all ids are known."""
    if mode == "full":
        return pages
    only = F.forall("ids", lambda i: F.array_contains("known", i))
    if mode == "resume":
        return pages.where(~only)
    marked = pages.withColumn("_only", only & (F.col("page") >= from_page))
    follows = marked.select((F.col("page") + 1).alias("page"), F.col("_only").alias("_before"))
    rows = marked.join(follows, "page", "left")
    end = rows.where(F.col("_only") & F.coalesce("_before", F.lit(False)) if known_pages == 2 else F.col("_only")).agg(F.min("page").alias("_end"))
    return rows.join(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("page") <= F.col("_end"))).select(*pages.columns)
