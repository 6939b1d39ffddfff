"""What several operators share: the word pattern, shared folders, written tables, running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of its own only where that is unset and driver and executors are one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key alone: `hash_share(id, s) < p` samples a share p without a shuffle."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` up to and with this row, by `keys`, in the order (`bucket`, *order).

    Two levels, so that no window holds a whole key: rows are summed by bucket, the few bucket sums get their
    own running total, and rows add what precedes them inside their bucket. Rows of a bucket must precede, in
    the order asked for, all rows of larger buckets.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_in_bucket"))
    before = sums.withColumn("_before", F.sum("_in_bucket").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("_in_bucket")).drop("_in_bucket")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("_within", F.sum(value).over(within))
    same = None
    for k in [*keys, bucket]:
        c = inner[k].eqNullSafe(before[k])
        same = c if same is None else same & c
    joined = inner.join(before, same, "left")
    return joined.select(*(inner[c] for c in df.columns), (F.col("_before") + F.col("_within")).alias(out))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node that it reaches. Stars alternate (large, then small) until nothing changes; each round is written to the shared folder."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    seen = mark(e)
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        e = written(small, "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
