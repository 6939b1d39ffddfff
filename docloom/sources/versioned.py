"""Tables kept by key in hash buckets and versions: a change rewrites only the buckets that it touches.

    data/<change>/bucket=<b>/...     rows of a bucket as some change left them
    versions/<number>.json           a manifest: where the rows of each bucket are

A change writes its buckets beside the others, and then the next manifest, whose name can be taken once: that is the only
step by which readers see it, and by which one of two writers fails. What a lost job left behind is named by no manifest; the
next change removes it. Batches have numbers, so that one that is run again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.shared import unused, written
from docloom.sources.sinks import file_system


def read_text(spark: SparkSession, path: str) -> str:
    fs, kind = file_system(spark, path)
    stream = fs.open(kind(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def take_name(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole under a name that nothing has yet; False where something has it."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    fs, kind = file_system(spark, path)
    folder, name = path.rsplit("/", 1)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    fs.mkdirs(kind(folder))
    stream = fs.create(kind(beside), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    none = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(kind(path).toUri(), sc._jsc.hadoopConfiguration()).rename(kind(beside), kind(path), none)
    except Exception as e:  # the renaming call fails, and changes nothing, where the name is taken
        fs.delete(kind(beside), False)
        if fs.exists(kind(path)):
            return False
        raise e
    return True


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the .json files in a folder, rising."""
    fs, kind = file_system(spark, folder)
    if not fs.exists(kind(folder)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(kind(folder))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


@dataclass
class Lease:
    """The right to write for so many seconds; a later holder's greater token ends it."""

    spark: SparkSession
    folder: str
    token: int
    seconds: float
    until: float = 0.0

    def renew(self) -> None:
        """Another `seconds` from now; fails where another has taken over."""
        self.check()
        self.until = time.time() + self.seconds
        take_name(self.spark, f"{self.folder}/{self.token:010}-{time.time_ns()}.renewed", json.dumps({"until": self.until}))

    def check(self) -> None:
        """Fails for a holder whose token is no longer the last, or whose time is over."""
        if numbers(self.spark, self.folder)[-1] != self.token or time.time() > self.until:
            raise RuntimeError(f"the lease with token {self.token} is no longer held")


def last_lease(spark: SparkSession, folder: str) -> tuple[int, float]:
    """(token, until when) of the last lease, (0, 0) if there was none."""
    known = numbers(spark, folder)
    if not known:
        return 0, 0.0
    fs, kind = file_system(spark, folder)
    own = f"{known[-1]:010}"
    names = [f.getPath().getName() for f in fs.listStatus(kind(folder))]
    said = [json.loads(read_text(spark, f"{folder}/{n}"))["until"] for n in names if n.startswith(own) and n.endswith((".json", ".renewed"))]
    released = f"{own}.released" in names
    return known[-1], 0.0 if released else max(said)


@contextmanager
def leased(spark: SparkSession, path: str, seconds: float = 600.0):
    """A lease on `path` for one writer, beside it; a second one fails at once, and takes over when the time of a killed one is over."""
    folder = path.rstrip("/") + ".lease"
    token, until = last_lease(spark, folder)
    if until > time.time():
        raise RuntimeError(f"another writer holds {path} for {until - time.time():.0f} s")
    lease = Lease(spark, folder, token + 1, seconds, time.time() + seconds)
    if not take_name(spark, f"{folder}/{lease.token:010}.json", json.dumps({"until": lease.until})):
        raise RuntimeError(f"another writer was faster to take {path}")
    try:
        yield lease
    finally:
        take_name(spark, f"{folder}/{lease.token:010}.released", "{}")


@dataclass
class Versioned:
    """A table below `path`, by `key`, in `buckets` hash buckets, of which the last `keep` versions can be read."""

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = 64
    keep: int = 2
    lease: Lease | None = None

    def bucket(self) -> Column:
        """By the first 32 bits of the MD5 of the key's text, nulls as empty, so that any engine finds it."""
        text = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.key))
        return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int | None = None) -> dict | None:
        known = numbers(self.spark, f"{self.path}/versions")
        if not known:
            return None
        version = known[-1] if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version:010}.json"))

    def rows(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table at a version (the last), or some of its buckets; None before the first version."""
        m = self.manifest(version)
        return None if m is None else self.of(m, only)

    def of(self, m: dict, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        folders = sorted({f"{self.path}/{f}" for b, f in m["folders"].items() if only is None or int(b) in only})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, update: DataFrame, order: list[str] | None = None, batch: int | None = None) -> dict:
        """Puts the rows of update in place of those of the same key, or adds them; with `order` the last row of a key stays, whichever side has it.

        Without an order a key that the update has twice fails the job. A batch whose number is not above the table's is
        done already. Gives the manifest that holds afterwards.
        """
        old = self.manifest()
        if old is not None and batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return old
        (mark,) = unused(update, "bucket")
        new = written(update.withColumn(mark, self.bucket()), "update")
        if order is None and not new.groupBy(*self.key).count().where("count > 1").isEmpty():
            raise ValueError(f"the update has a key ({', '.join(self.key)}) more than once")
        touched = [r[0] for r in new.select(mark).distinct().collect()]
        there = None if old is None else self.of(old, touched).withColumn(mark, self.bucket())
        if order is None:
            kept = there if there is None else there.join(new.select(*self.key).distinct(), [there[k].eqNullSafe(new[k]) for k in self.key], "left_anti")
            rows = new if kept is None else kept.unionByName(new, allowMissingColumns=True)
        else:
            both = new if there is None else there.unionByName(new, allowMissingColumns=True)
            rest = [c for c in both.columns if c not in self.key]
            rows = both.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*self.key, "_r.*")
        return self.replace(old, rows, touched, mark, batch)

    def refresh(self, update: DataFrame, column: str, order: list[str] | None = None, batch: int | None = None) -> dict:
        """Takes `column` from update where it has the key and another value; buckets without such a row are not rewritten.

        Of a key that the update has twice the last by `order` counts; without an order that fails the job.
        """
        old = self.manifest()
        if old is None or (batch is not None and old["batch"] is not None and batch <= old["batch"]):
            return old
        if order is None:
            if not update.groupBy(*self.key).count().where("count > 1").isEmpty():
                raise ValueError(f"the update has a key ({', '.join(self.key)}) more than once")
            last = update.select(*self.key, F.col(column).alias("_new"))
        else:
            last = update.groupBy(*self.key).agg(F.max_by(column, F.struct(*order)).alias("_new"))
        now = self.of(old)
        (mark,) = unused(now, "bucket")
        joined = now.withColumn(mark, self.bucket()).join(last, self.key, "left")
        other = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column))
        touched = [r[0] for r in joined.where(other).select(mark).distinct().collect()]
        if not touched:
            return old
        rows = joined.where(F.col(mark).isin(touched)).withColumn(column, F.coalesce("_new", column)).select(*now.columns, mark)
        return self.replace(old, rows, touched, mark, batch)

    def replace(self, old: dict | None, rows: DataFrame, touched: list[int], mark: str, batch: int | None) -> dict:
        """The next version: `rows` in the touched buckets, the others as they were."""
        folder = f"data/{uuid.uuid4().hex}"
        plain = rows.drop(mark)
        rows.withColumn("bucket_", F.col(mark)).drop(mark).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        fs, kind = file_system(self.spark, self.path)
        made = {b: f"{folder}/bucket_={b}" for b in touched if fs.exists(kind(f"{self.path}/{folder}/bucket_={b}"))}
        folders = {int(b): f for b, f in ({} if old is None else old["folders"]).items() if int(b) not in touched} | made
        number = 1 if old is None else old["version"] + 1
        m = {"version": number, "batch": batch if batch is not None else (old or {}).get("batch"), "key": self.key, "buckets": self.buckets, "schema": plain.schema.jsonValue(), "folders": folders, "rewritten": sorted(touched)}
        self.publish(m)
        self.prune(m)
        return m

    def publish(self, m: dict) -> None:
        """The one step by which a version begins to be."""
        if self.lease is not None:
            self.lease.check()
        if not take_name(self.spark, f"{self.path}/versions/{m['version']:010}.json", json.dumps(m)):
            raise RuntimeError(f"version {m['version']} of {self.path} has been written by another")

    def prune(self, m: dict) -> None:
        """Removes manifests before the last `keep`, and data that no manifest names. Readers of removed versions fail."""
        fs, kind = file_system(self.spark, self.path)
        known = numbers(self.spark, f"{self.path}/versions")
        for n in known[: -self.keep]:
            fs.delete(kind(f"{self.path}/versions/{n:010}.json"), False)
        named = {f for n in known[-self.keep :] for f in self.manifest(n)["folders"].values()}
        for change in fs.listStatus(kind(f"{self.path}/data")):
            own = f"data/{change.getPath().getName()}"
            parts = [f"{own}/{p.getPath().getName()}" for p in fs.listStatus(change.getPath())]
            for p in parts:
                if p not in named and "bucket_=" in p:
                    fs.delete(kind(f"{self.path}/{p}"), True)
            if not any(p in named for p in parts):
                fs.delete(change.getPath(), True)
