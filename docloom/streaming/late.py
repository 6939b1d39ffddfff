"""Windows over a stream that lose no late row, and streams that stop at quotas.

Late rows are those of windows that have ended before the watermark: they go to a sink of their own, with their window, and
a correction folds both together. Counts of windows are a versioned table of which a batch rewrites only the buckets that
it touches; batches that are run again change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.shared import written
from docloom.sources.versioned import Versioned, file_system, read_text, take_name


@dataclass
class LateWindows:
    """Counts and sums by window (tumbling, or sliding by `slide`) and `group`, below `path`; rows are late by `late` after the newest."""

    path: str
    at: str
    length: str
    group: list[str]
    value: str
    late: str
    slide: str | None = None
    buckets: int = 16

    def keys(self) -> list[str]:
        return ["window_start", *self.group]

    def table(self, spark) -> Versioned:
        return Versioned(spark, f"{self.path}/windows", self.keys(), self.buckets)

    def windowed(self, rows: DataFrame) -> DataFrame:
        own = rows.select(F.window(self.at, self.length, self.slide).alias("_w"), self.at, *self.group, self.value)
        return own.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), self.at, *self.group, self.value)

    def counted(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys()).agg(F.count("*").alias("events"), F.sum(self.value).alias("total"))

    def newest(self, spark, number: int) -> float | None:
        """The newest event time, in seconds, of the batches before this one."""
        path = f"{self.path}/newest/{number - 1:010}.json"
        fs, kind = file_system(spark, path)
        return json.loads(read_text(spark, path))["at"] if number > 0 and fs.exists(kind(path)) else None

    def fold(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self.newest(spark, number)
        rows = written(self.windowed(batch), "windowed")
        behind = F.lit(False) if before is None else F.col("window_end") <= F.timestamp_micros(F.lit(round(before * 1e6))) - F.expr(f"INTERVAL {self.late}")
        rows.where(behind).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        new = self.counted(rows.where(~behind))
        table = self.table(spark)
        old = table.rows()
        if old is not None and (table.manifest()["batch"] or 0) < number:
            known = old.select(*(F.col(k).alias(f"_{k}") for k in self.keys()), F.col("events").alias("_events"), F.col("total").alias("_total"))
            joined = new.join(known, [new[k].eqNullSafe(known[f"_{k}"]) for k in self.keys()], "left")
            zero = lambda c: F.coalesce(c, F.lit(0))
            new = joined.select(*self.keys(), (F.col("events") + zero("_events")).alias("events"), F.when(F.col("total").isNull() & F.col("_total").isNull(), None).otherwise(zero("total") + zero("_total")).alias("total"))
        table.upsert(new, batch=number)
        top = batch.agg(F.max(F.unix_micros(F.col(self.at)) / 1e6)).first()[0]
        now = max((x for x in (before, top) if x is not None), default=None)
        take_name(spark, f"{self.path}/newest/{number:010}.json", json.dumps({"at": now}))

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def late_rows(self, spark) -> DataFrame:
        """The rows that came too late, each with its windows and the batch it came in."""
        return spark.read.parquet(f"{self.path}/late")

    def corrected(self, spark) -> DataFrame:
        """Windows with their late rows: what a batch over all rows counts."""
        both = self.table(spark).rows().unionByName(self.counted(self.late_rows(spark)))
        return both.groupBy(*self.keys()).agg(F.sum("events").alias("events"), F.sum("total").alias("total"))


def counted_stream(stream: DataFrame, category: str, passed: Column, order: list[str], quota: int | None = None, empties: int | None = None) -> DataFrame:
    """Rows of each category as they come, up to the one with which `quota` have passed, or up to the last of `empties` rows in a row that have not.

    The state of a category is two counters. Rows of a batch go by the order; batches are to come in it. Equal to
    `until_quota` and `until_empty` over all rows.
    """
    ready = stream.withColumn("_passed", F.coalesce(passed, F.lit(False)))
    columns = stream.columns

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, empty = state.get if state.exists else (0, 0)
        over = lambda: (quota is not None and done >= quota) or (empties is not None and empty >= empties)
        if over():
            return
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        kept = 0
        for p in rows["_passed"]:
            if over():
                break
            done, empty, kept = done + int(p), 0 if p else empty + 1, kept + 1
        state.update((done, empty))
        yield rows.iloc[:kept][columns]

    return ready.groupBy(category).applyInPandasWithState(step, stream.schema, "done long, empty long", "append", GroupStateTimeout.NoTimeout)
