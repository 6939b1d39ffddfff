"""A ledger of seen keys with Bloom bitmaps: rows whose key was certainly not seen pass at once, only the others meet the keys themselves.

Keys live in hash buckets of a versioned table, and each bucket has a bitmap in another, made of its new keys alone and
merged with the old one by OR. Bitmaps of up to SENT bytes in all are sent to the tasks, and rows are not shuffled to be
looked up; larger ones meet the rows bucket by bucket. What passes does not depend on the bitmaps, only the work does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shared import unused
from docloom.sources.versioned import Versioned

#: Bits that a key sets, and bytes of bitmaps in all that may be sent to every task.
PROBES, SENT = 5, 64 << 20


def places(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bits of each key, by double hashing."""
    steps = np.arange(PROBES, dtype=np.uint64)[None, :]
    return ((one.view(np.uint64)[:, None] + steps * (two.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


def holds(bitmap: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    at = places(one, two, len(bitmap) * 8)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


@dataclass
class Ledger:
    """Keys (columns `key`) seen by earlier runs, below `path`; `bits` is the size of a bucket's bitmap, a multiple of 8."""

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = 64
    bits: int = 1 << 20

    def __post_init__(self) -> None:
        self.keys = Versioned(self.spark, f"{self.path}/keys", self.key, self.buckets)
        self.maps = Versioned(self.spark, f"{self.path}/bitmaps", ["bucket"], self.buckets)

    def hashes(self) -> list[Column]:
        return [F.xxhash64(*self.key, F.lit(seed)) for seed in (1, 2)]

    def record(self, rows: DataFrame, run: int) -> None:
        """Adds the keys of rows, once for each number of a run; the bitmaps go first, so that a lost run leaves no key that they don't know."""
        new = rows.select(*self.key).distinct()
        hashed = new.select(self.keys.bucket().alias("bucket"), *(h.alias(n) for h, n in zip(self.hashes(), ("one", "two"), strict=True)))
        bits, size = self.bits, self.bits // 8

        def made(table: pa.Table) -> pa.Table:
            bitmap = np.zeros(size, np.uint8)
            at = places(table["one"].to_numpy(), table["two"].to_numpy(), bits).ravel()
            np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "bitmap": pa.array([bitmap.tobytes()], pa.binary())})

        def merged(table: pa.Table) -> pa.Table:
            whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table["bitmap"].to_pylist()])
            return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "bitmap": pa.array([whole.tobytes()], pa.binary())})

        fresh = hashed.withColumn("part", F.pmod("one", F.lit(16))).groupBy("bucket", "part").applyInArrow(made, "bucket int, bitmap binary")
        old = self.maps.rows()
        both = fresh if old is None else fresh.unionByName(old.join(fresh.select("bucket").distinct(), "bucket", "left_semi"))
        self.maps.upsert(both.groupBy("bucket").applyInArrow(merged, "bucket int, bitmap binary"), batch=run)
        self.keys.upsert(new, batch=run)

    def marked(self, rows: DataFrame, mark: str) -> DataFrame:
        """rows with `mark`: whether their key may have been seen."""
        maps = self.maps.rows()
        if maps is None:
            return rows.withColumn(mark, F.lit(False))
        bucket, one, two = unused(rows, "_bucket", "_one", "_two")
        hashed = rows.withColumns({bucket: self.keys.bucket(), one: self.hashes()[0], two: self.hashes()[1]})
        if self.buckets * self.bits // 8 > SENT:
            return self.by_bucket(rows, hashed, maps, mark, [bucket, one, two])
        held = self.spark.sparkContext.broadcast({r["bucket"]: bytes(r["bitmap"]) for r in maps.collect()})
        names = [*rows.columns, bucket, one, two]

        @F.arrow_udf("boolean")
        def maybe(buckets: pa.Array, ones: pa.Array, twos: pa.Array) -> pa.Array:
            b, x, y = (c.to_numpy(zero_copy_only=False) for c in (buckets, ones, twos))
            out = np.zeros(len(b), bool)
            for k in np.unique(b):
                own = b == k
                if int(k) in held.value:
                    out[own] = holds(np.frombuffer(held.value[int(k)], np.uint8), x[own], y[own])
            return pa.array(out)

        return hashed.select(*names).withColumn(mark, maybe(bucket, one, two)).drop(bucket, one, two)

    def by_bucket(self, rows: DataFrame, hashed: DataFrame, maps: DataFrame, mark: str, extra: list[str]) -> DataFrame:
        from pyspark.sql import types as T

        (bucket, one, two), columns = extra, rows.columns
        schema = T.StructType([*rows.schema.fields, T.StructField(mark, T.BooleanType())])

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            found = np.zeros(left.num_rows, bool)
            if right.num_rows and left.num_rows:
                found = holds(np.frombuffer(right["bitmap"][0].as_py(), np.uint8), left[one].to_numpy(), left[two].to_numpy())
            return left.select(columns).append_column(mark, pa.array(found))

        parts = F.explode(F.sequence(F.lit(0), F.lit(15)))  # a hot bucket is dealt out, its bitmap is copied
        left = hashed.withColumn("_part", F.pmod(F.xxhash64(*hashed.columns), F.lit(16)).cast("int"))
        right = maps.withColumn("_part", parts).withColumnRenamed("bucket", bucket)
        return left.groupBy(bucket, "_part").cogroup(right.groupBy(bucket, "_part")).applyInArrow(look, schema)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key no run has recorded. Null keys are values like any other."""
        (mark,) = unused(rows, "_maybe")
        marked = self.marked(rows, mark)
        known = self.keys.rows()
        if known is None:
            return rows
        some = marked.where(mark)
        left = some.join(known, [some[k].eqNullSafe(known[k]) for k in self.key], "left_anti")
        return marked.where(~F.col(mark)).unionByName(left).drop(mark)

    def passed_on(self, rows: DataFrame) -> float:
        """The share of rows that the bitmaps send on to the exact comparison."""
        (mark,) = unused(rows, "_maybe")
        return self.marked(rows, mark).agg(F.avg(F.col(mark).cast("int"))).first()[0] or 0.0
