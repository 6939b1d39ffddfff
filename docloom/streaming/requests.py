"""Requests from pending to answered or failed as a stateful processor over event time, with expiry; and the same by replay of a batch.

State is a row for each request, kept in RocksDB (`spark.sql.streaming.stateStore.providerClass`). A request is created once,
goes from pending to answered or failed once, whatever comes later or again, and is removed when it is older than the
retention. Removal is timed by the watermark, at full hours, so that it happens at most hourly however many requests there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "status string, created_ms long, settled_ms long, text string"
OUT = "id long, status string, created_at timestamp, settled_at timestamp, text string"
ERROR_CHARS, HOUR_MS = 1000, 3_600_000


def use_rocksdb(spark: SparkSession) -> None:
    """State stores that processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def ends_at(created_ms: int, retention_ms: int) -> int:
    """The first full hour at which a request is older than the retention."""
    return -(-(created_ms + retention_ms) // HOUR_MS) * HOUR_MS


def at(ms: int | None) -> datetime | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc)


class Requests(StatefulProcessor):
    """Rows (id, status, at, text): `created` opens a request, answered and failed settle it if it is pending."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", STATE)

    def row(self, key: tuple, status: str, created: int, settled: int | None, text: str | None) -> pd.DataFrame:
        zone = lambda ms: pd.Series([pd.NaT if ms is None else pd.Timestamp(at(ms)).tz_localize(None)], dtype="datetime64[ns]")
        return pd.DataFrame({"id": [key[0]], "status": [status], "created_at": zone(created), "settled_at": zone(settled), "text": pd.Series([text], dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = tuple(self.state.get()) if self.state.exists() else None
        before = known
        every = pd.concat(list(rows)).sort_values(["at", "status"], kind="stable")
        for status, when, text in zip(every["status"], every["at"], every["text"], strict=True):
            ms = int(pd.Timestamp(when).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(when).tzinfo is None else int(pd.Timestamp(when).timestamp() * 1000)
            if status == "created":
                known = known or ("pending", ms, None, None)
            elif known and known[0] == "pending" and status in ("answered", "failed"):
                known = (status, known[1], ms, None if text is None else text[:ERROR_CHARS] if status == "failed" else text)
        if known is None or known == before:
            return
        if before is None:
            self.handle.registerTimer(ends_at(known[1], self.retention_ms))
        self.state.update(known)
        yield self.row(key, *known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            _, created, settled, _ = self.state.get()
            self.state.clear()
            yield self.row(key, "expired", created, settled, None)

    def close(self) -> None:
        pass


def request_changes(events: DataFrame, retention: str = "120 days", late: str = "1 hour") -> DataFrame:
    """OUT whenever a request (id, status, at, text) is created, settled or removed; rows later than `late` are left out."""
    days = pd.Timedelta(retention)
    rows = events.select(F.col("id").cast("long").alias("id"), "status", "at", "text").withWatermark("at", late)
    return rows.groupBy("id").transformWithStateInPandas(Requests(int(days.total_seconds() * 1000)), OUT, "Update", "EventTime")


def replayed(events: DataFrame, now: Column, retention: str = "120 days") -> DataFrame:
    """OUT of each request after all of a batch's events, those that are over at `now` as expired: one aggregation."""
    opened = F.min(F.when(F.col("status") == "created", F.col("at")))
    rows = events.join(events.groupBy("id").agg(opened.alias("created_at")).where("created_at IS NOT NULL"), "id")
    settles = F.col("status").isin("answered", "failed") & (F.col("at") >= F.col("created_at"))
    first = F.min_by(F.when(settles, F.struct("status", "at", "text")), F.when(settles, F.struct("at", "status")))
    one = rows.groupBy("id", "created_at").agg(first.alias("s"))
    seconds = int(pd.Timedelta(retention).total_seconds())
    over = F.ceil((F.unix_timestamp("created_at") + seconds) / 3600) * 3600 <= F.unix_timestamp(now)
    status = F.when(over, "expired").otherwise(F.coalesce("s.status", F.lit("pending")))
    text = F.when(~over, F.when(F.col("s.status") == "failed", F.substring("s.text", 1, ERROR_CHARS)).otherwise(F.col("s.text")))
    return one.select("id", status.alias("status"), "created_at", F.col("s.at").alias("settled_at"), text.alias("text"))
