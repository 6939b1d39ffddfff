"""Sinks and keyed maintenance: refuse or replace, upsert by key, refresh one column, retention, reports."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, its Path class): for renames, deletions and exclusive creation, on any store."""
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def write_new(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON Lines; refuses to replace what is there unless told to, and never replaces it by nothing.

    A replacement is written beside the output and takes its place by renames once it is whole; where a job was lost between
    the renames, `recovered` puts the output back, and so does the next writer.
    """
    recovered(df.sparkSession, path)
    if not overwrite:
        df.write.mode("errorifexists").json(path, ignoreNullFields=False)
        return
    if df.isEmpty():
        raise ValueError("an empty result does not replace an output")
    fs, kind = file_system(df.sparkSession, path)
    new, old = (f"{path.rstrip('/')}.{mark}-{uuid.uuid4().hex}" for mark in ("new", "old"))
    df.write.json(new, ignoreNullFields=False)
    there = fs.exists(kind(path))
    if there and not fs.rename(kind(path), kind(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(kind(new), kind(path)):
        if there:
            fs.rename(kind(old), kind(path))
        raise OSError(f"{new} can't take the place of {path}")
    if there:
        fs.delete(kind(old), True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Puts back the output that a lost job had moved aside before its replacement took the place; leftovers of lost jobs go. True if an output was put back."""
    fs, kind = file_system(spark, path)
    place = kind(path.rstrip("/"))
    beside = place.getParent()
    if beside is None or not fs.exists(beside):
        return False
    names = {m: [f.getPath() for f in fs.listStatus(beside) if f.getPath().getName().startswith(f"{place.getName()}.{m}-")] for m in ("old", "new")}
    back = bool(names["old"]) and not fs.exists(place) and fs.rename(names["old"][0], place)
    for p in [*names["old"], *names["new"]]:
        if fs.exists(p):
            fs.delete(p, True)
    return back


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a JSON Lines output; a job that fails adds none."""
    df.write.mode("append").json(path, ignoreNullFields=False)


def truncate(spark: SparkSession, path: str) -> None:
    """Empties an output; the folder stays."""
    fs, kind = file_system(spark, path)
    fs.delete(kind(path), True)
    fs.mkdirs(kind(path))


@contextmanager
def single_writer(spark: SparkSession, path: str, seconds: float = 600.0):
    """Lets one writer at a time work on `path`: a lease (see `versioned.leased`), so that a killed writer blocks others for its time only."""
    from docloom.sources.versioned import leased

    with leased(spark, path, seconds) as lease:
        yield lease


def check_paths(*paths: str) -> None:
    if len({p.rstrip("/") for p in paths}) != len(paths):
        raise ValueError("input, output and report must differ")


def one_by_key(update: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """update with a row for each key: the last by `order`; without one a key that stands twice fails the job."""
    rest = [c for c in update.columns if c not in key]
    if order is not None:
        return update.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
    twice = F.raise_error(F.concat(F.lit("a key stands more than once: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in key)))).cast("boolean")
    rows = update.groupBy(*key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    return rows.where(F.when(F.col("_n") > 1, twice).otherwise(True)).select(*key, "_r.*")


def upsert(base: DataFrame, update: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """base with the rows of update in place of those of the same key, or added; see `one_by_key` for keys that update has twice.

    `sources.versioned` keeps such a table in files of which only those that change are rewritten.
    """
    new = one_by_key(update, key, order)
    return base.join(update.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def refresh(base: DataFrame, update: DataFrame, key: list[str], column: str, order: list[str] | None = None) -> DataFrame:
    """base with `column` taken from update where it has the key and another value, and `changed`; see `one_by_key` for keys that update has twice."""
    kept = update.select(*dict.fromkeys([*key, column, *(order or [])]))
    new = one_by_key(kept, key, order).select(*key, F.col(column).alias("_new"))
    joined = base.join(new, key, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column))
    return joined.withColumn("changed", changed).withColumn(column, F.coalesce("_new", column)).drop("_new")


def retained(log: DataFrame, created: str, now: Column, months: int) -> DataFrame:
    """Rows not older than so many months."""
    return log.where(F.col(created) >= now - F.make_interval(months=F.lit(months)))


def to_chat(df: DataFrame, question: str, answer: str) -> DataFrame:
    """df with `messages`: the question as user, the answer as assistant."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.withColumn("messages", F.array(turn("user", question), turn("assistant", answer)))


def to_instruction(df: DataFrame) -> DataFrame:
    """(instruction, input, output) from any of the names that records use."""
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns), F.lit(""))
    return df.select(first("instruction", "question").alias("instruction"), F.lit("").alias("input"), first("output", "answer").alias("output"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report (a row, or a row for each group) as one JSON file beside its output."""
    df.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, decimals: int = 4) -> None:
    """CSV with a byte-order mark, a header and doubles at so many decimals."""
    shown = {n: F.format_string(f"%.{decimals}f", F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    rows = df.withColumns({n: F.when(F.col(n).isNotNull(), c) for n, c in shown.items()})
    rows.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).write.mode("overwrite").csv(path, header=True)


def copy_legacy(target: DataFrame, legacy: DataFrame | None) -> DataFrame:
    """target, or the legacy rows with status `legacy` where it is empty and there are some."""
    if legacy is None or not target.isEmpty():
        return target
    return legacy.withColumn("status", F.lit("legacy")).select(*target.columns)


#: Files up to this size are digested by tasks, as one value each; larger ones are streamed, a buffer at a time.
WHOLE_FILE = 256 << 20


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """(path, length, sha256) of the files below path, of any size; tasks read small files, and large ones pass through one buffer of the JVM."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = []
    digest = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils
    for r in files.where(F.col("length") > whole).select("path", "length").collect():
        fs, kind = file_system(spark, r["path"])
        stream = fs.open(kind(r["path"]))
        try:
            large.append((r["path"], r["length"], digest.sha256Hex(stream)))
        finally:
            stream.close()
    return small.unionByName(spark.createDataFrame(large, "path string, length long, sha256 string"))


def unchanged_input(spark: SparkSession, path: str):
    """A function that tells whether the files below path are still those of now: one checksum over names, sizes and digests of contents."""

    def state() -> tuple:
        each = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "length", "sha256"), 256), 1, 15), 16, 10)
        return tuple(file_digests(spark, path).agg(F.count("*"), F.sum("length"), F.sum(each.cast("decimal(38,0)"))).first())

    before = state()
    return lambda: state() == before
