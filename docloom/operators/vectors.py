"""Vector tables: exact filtered top-k, merges over collections, snapshot diffs, soft deletes and the readiness gate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import cells


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; null where a vector has no length."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(index: DataFrame, query: list[float], k: int, where: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows of one query, ties by key, vectors without length last: partial top-k in each partition, one merge."""
    rows = index if where is None else index.where(where)
    literal = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", cosine_distance(F.col(vector), literal)).orderBy(F.asc_nulls_last("distance"), key).limit(k)


def nearest(index: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", block: int = 1024, slice_rows: int | None = None) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of every query, exact, ties by key, by comparing all; `cells.search` compares fewer.

    Queries are dealt into blocks of about `block` rows and the index into slices of about 16 MB of vectors; each pair of a
    block and a slice meets in one task, which sends on its k best of each query, and these are ranked. Nothing passes
    through the driver but counts.
    """
    size = index.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    slice_rows = slice_rows or max(1, cells.SLICE_BYTES // (8 * max(1, size["width"] or 1)))
    blocks, slices = max(1, -(-queries.count() // block)), max(1, -(-size["n"] // slice_rows))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("qv"), own(key, blocks).alias("b"), every(slices).alias("s"))
    rows = index.select(key, vector, own(key, slices).alias("s"), every(blocks).alias("b"))

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", key, "distance"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        who, q, ids, x = left["query_id"].to_numpy(), cells.unit(cells.matrix(left["qv"])), right[key].to_numpy(), cells.unit(cells.matrix(right[vector]))
        step = max(1, (4 << 20) // len(ids))  # distances of 32 MB at once
        found = [cells.best_of(who[lo : lo + step], ids, 1 - q[lo : lo + step] @ x.T, k) for lo in range(0, len(who), step)]
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    found = asked.groupBy("b", "s").cogroup(rows.groupBy("b", "s")).applyInArrow(ranked, f"query_id long, {key} long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def merged(parts: list[DataFrame], k: int, key: str = "vec_id") -> DataFrame:
    """The k nearest of several collections' top-k, ties by collection, then key."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("collection", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.orderBy(F.asc_nulls_last("distance"), "collection", key).limit(k)


def snapshot_diff(stored: DataFrame, snapshot: DataFrame, key: str, content: str, meta: str) -> DataFrame:
    """(key, change): new, changed, metadata, same, stale or gone (stale before). One full outer join."""
    s = stored.select(F.col(key), F.col(content).alias("_c"), F.col(meta).alias("_m"), F.col("active").alias("_a"))
    n = snapshot.select(F.col(key), F.col(content).alias("_nc"), F.col(meta).alias("_nm"), F.lit(True).alias("_in"))
    change = (
        F.when(F.col("_in").isNull(), F.when(F.col("_a"), "stale").otherwise("gone"))
        .when(F.col("_c").isNull(), "new")
        .when(F.col("_c") != F.col("_nc"), "changed")
        .when(~F.col("_m").eqNullSafe(F.col("_nm")) | ~F.col("_a"), "metadata")
        .otherwise("same")
    )
    return s.join(n, key, "full_outer").select(key, change.alias("change"))


def maintain(stored: DataFrame, snapshot: DataFrame, encode: Callable[[DataFrame], DataFrame], key: str = "chunk_id", content: str = "content_hash", meta: str = "metadata") -> DataFrame:
    """The next vector table: only new and changed rows are encoded, stale ones become inactive, none is deleted.

    `encode` adds `embedding` to the rows it gets, which is the delta alone.
    """
    own = stored.select(key, F.col(content).alias("_c"), F.col("embedding").alias("_e"), F.lit(True).alias("_in"))
    joined = snapshot.join(own, key, "left")
    same = F.col("_in").isNotNull() & F.col("_c").eqNullSafe(F.col(content))  # a new row without a hash is new
    delta = encode(joined.where(~same).drop("_c", "_e", "_in"))
    reused = joined.where(same).withColumn("embedding", F.col("_e")).drop("_c", "_e", "_in")
    gone = stored.join(snapshot.select(key), key, "left_anti").withColumn("active", F.lit(False))
    current = delta.unionByName(reused).withColumn("active", F.lit(True))
    return current.select(*stored.columns).unionByName(gone.select(*stored.columns))


def letter_embedder(letters: str = "aeiou", text: str = "chunk_text") -> Callable[[DataFrame], DataFrame]:
    """A stand-in that any engine can follow: how often each of these letters stands in the text, normalised; native."""
    count = lambda c: (F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("double")
    raw = F.array(*map(count, letters))
    return lambda df: df.withColumn("_v", raw).withColumn("embedding", F.transform("_v", lambda x: F.coalesce(F.try_divide(x, F.sqrt(dot(F.col("_v"), F.col("_v")))), F.lit(0.0)).cast("float"))).drop("_v")


def check_ready(manifest: dict, model: str, dimension: int) -> None:
    """Refuses a search over an index that is not ready, empty or of another model."""
    if manifest.get("state") != "ready" or manifest.get("active", 0) < 1:
        raise ValueError("the index is not ready")
    if (manifest.get("model"), manifest.get("dimension"), manifest.get("metric")) != (model, dimension, "cosine"):
        raise ValueError("the index was made by another model")


def hashing_embedder(dimension: int = 64, text: str = "chunk_text") -> Callable[[DataFrame], DataFrame]:
    """A deterministic stand-in for a model: signed counts of hashed words, normalised; native."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimension)).alias("p"), (1 - 2 * F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))).cast("double").alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(hashed, lambda h: h["p"] == i), F.lit(0.0), lambda a, h: a + h["s"]))
    return lambda df: df.withColumn("_v", raw).withColumn("embedding", F.transform("_v", lambda x: F.try_divide(x, F.sqrt(dot(F.col("_v"), F.col("_v")))).cast("float"))).drop("_v")
