"""A cell index for exact nearest vectors: k-means cells as table partitions, pruned by the triangle inequality.

Rows belong to the nearest of a bounded number of centers, which are fitted on a bounded sample; every row is indexed. On unit
vectors 2 * (1 - cosine) is the squared distance, so a row of a cell is no nearer to a query than the query's distance to
the center less the cell's radius. A search visits the nearest cells first, and then only those whose bound does not
exceed the k-th distance found, so its answers are exact whatever the cells are like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.shared import new_dir, unused, written

#: Cells at most, rows of the sample on which centers are fitted, rounds of fitting, bytes of vectors in a slice of a cell, queries in a block.
MOST_CELLS, SAMPLE, ROUNDS, SLICE_BYTES, BLOCK = 4096, 20_000, 6, 16 << 20, 1024
#: The cell of vectors without length, whose distance to everything is 1; it is always visited. Slack for rounding.
NO_LENGTH, SLACK = -1, 1e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), float).reshape(len(whole), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, those without length as zeros."""
    size = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The distance of every row to every center."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T, 0))


def fitted_centers(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds on unit vectors, from rows evenly taken; a center that loses all rows stays where it is."""
    centers = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy() if len(x) else np.zeros((0, 0))
    for _ in range(rounds if len(x) else 0):
        own = gaps(x, centers).argmin(1)
        count = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers[count > 0] = sums[count > 0] / count[count > 0, None]
    return centers


@dataclass
class CellIndex:
    """`rows` are all columns with `cell` and `slice`, partitioned by cell; `cells` are the numbers of cells that have rows, with their centers, radii, row and slice counts."""

    rows: DataFrame
    key: str
    vector: str
    cells: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    slices: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer to a query than this (in distance of unit vectors)."""
        low = np.maximum(gaps(x, self.centers) - self.radii[None, :] - SLACK, 0) if len(self.cells) else np.zeros((len(x), 0))
        low[:, self.cells == NO_LENGTH] = 0
        low[(x * x).sum(1) == 0] = 0
        return low


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, path: str | None = None) -> CellIndex:
    """The index of all rows that have a vector; written to `path` or the shared folder, partitioned by cell.

    A cell of many rows is cut into slices of about SLICE_BYTES by a hash of the key, so that no task holds a hot cell.
    Rows with a null vector are left out; vectors without length are a cell of their own; keys may repeat.
    """
    spark = df.sparkSession
    if {"cell", "slice"} & {c.lower() for c in df.columns}:
        raise ValueError("cell and slice are the index's own columns")
    cell, part, (gap,) = "cell", "slice", unused(df, "_gap")
    known = df.where(F.col(vector).isNotNull())
    total = known.count()
    cells = cells or int(min(MOST_CELLS, max(1, round(total**0.5 / 2))))
    share = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < int(min(1.0, 1.5 * SAMPLE / max(1, total)) * (1 << 20))
    sample = known.where(share).select(key, vector).limit(SAMPLE).toArrow().sort_by(key)
    x = unit(matrix(sample[vector])) if sample.num_rows else np.zeros((0, 1))
    x = x[(x * x).sum(1) > 0]
    centers = fitted_centers(x, min(cells, len(x)))
    sent = spark.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = unit(matrix(batch.column(batch.schema.get_field_index(vector)))) if batch.num_rows else np.zeros((0, 1))
            own, far = np.full(len(y), NO_LENGTH), np.zeros(len(y))
            some = np.flatnonzero((y * y).sum(1) > 0)
            for lo in range(0, len(some) if len(sent.value) else 0, 4096):
                at = some[lo : lo + 4096]
                d = gaps(y[at], sent.value)
                own[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], [*batch.schema.names, cell, gap])

    schema = T.StructType([*known.schema.fields, T.StructField(cell, T.IntegerType()), T.StructField(gap, T.DoubleType())])
    placed = written(known.mapInArrow(assign, schema), "cells")
    found = sorted(placed.groupBy(cell).agg(F.count("*").alias("n"), F.max(gap).alias("radius"), F.max(F.size(vector)).alias("width")).collect(), key=lambda r: r[cell])
    slices = [-(-r["n"] * r["width"] * 8 // SLICE_BYTES) for r in found]
    many = spark.createDataFrame([(r[cell], s) for r, s in zip(found, slices, strict=True)], f"{cell} int, _many int")
    cut = placed.join(F.broadcast(many), cell).withColumn(part, F.pmod(F.xxhash64(key), F.col("_many")).cast("int")).drop("_many", gap)
    path = path or new_dir(spark, "cell_index")
    cut.repartition(cell, part).write.partitionBy(cell).parquet(path)
    rows = spark.read.schema(cut.select(*(c for c in cut.columns if c != cell), cell).schema).parquet(path)
    numbers = np.array([r[cell] for r in found], int)
    own = np.stack([centers[c] if c != NO_LENGTH else np.zeros(centers.shape[1]) for c in numbers]) if len(numbers) else centers
    as_array = lambda name, kind: np.array([r[name] for r in found], kind)
    return CellIndex(rows, key, vector, numbers, own, as_array("radius", float), as_array("n", int), np.array(slices, int))


def top_k(index: CellIndex, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest rows of one query among those that pass `where`, ties by key: two partition-pruned scans and a merge. Columns are those of the rows, with `distance`."""
    from docloom.operators import vectors

    q = unit(np.array([query], float))
    low = index.bounds(q)[0]
    order = np.argsort(low, kind="stable")
    enough = int(np.searchsorted(np.cumsum(index.counts[order]), 4 * k)) + 1
    one = lambda at: vectors.top_k(index.rows.where(F.col("cell").isin([int(c) for c in index.cells[at]])), query, k, where, index.vector, index.key)
    first = written(one(order[:enough]), "nearest")
    worst = first.agg(F.count("distance").alias("n"), F.max("distance").alias("d")).first()
    reach = np.sqrt(max(0.0, 2 * worst["d"])) + SLACK if worst["n"] >= k else np.inf
    rest = order[enough:][low[order[enough:]] <= reach]
    every = first.unionByName(one(rest)) if len(rest) else first
    return every.orderBy(F.asc_nulls_last("distance"), index.key).limit(k).drop("cell", "slice")


def routed(index: CellIndex, queries: DataFrame, k: int, reach: bool) -> DataFrame:
    """(query_id, qv, cell, slice) of what each query has to visit: first the nearest cells that hold k rows, then (`reach` is a column of queries) all others within reach."""
    sent = queries.sparkSession.sparkContext.broadcast(index_of(index))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            low = own.bounds(unit(matrix(batch.column(1)))) if batch.num_rows else np.zeros((0, len(own.cells)))
            order = np.argsort(low, axis=1, kind="stable")
            before = np.cumsum(own.counts[order], axis=1) - own.counts[order]
            first = np.zeros(low.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            take = ~first & (low <= batch.column(2).to_numpy(zero_copy_only=False)[:, None]) if reach else first
            who, at = np.nonzero(take)
            many = own.slices[at]
            who, at = np.repeat(who, many), np.repeat(at, many)
            part = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["query_id", "qv"]).take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.cells[at].astype(np.int32)), pa.array(part.astype(np.int32))], ["query_id", "qv", "cell", "slice"])

    kind = dict(queries.dtypes)
    return queries.mapInArrow(route, f"query_id {kind['query_id']}, qv {kind['qv']}, cell int, slice int")


def index_of(index: CellIndex) -> CellIndex:
    """The index without its table, to be sent to tasks."""
    return CellIndex(None, index.key, index.vector, index.cells, index.centers, index.radii, index.counts, index.slices)


def best_of(who: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of distances the k least (at 12 decimals, ties by id), found by partition and sorted only then."""
    near = d.round(12)
    if near.shape[1] > k:
        near = np.where(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k], near, np.inf)
    row, col = np.nonzero(np.isfinite(near))
    by = np.lexsort((ids[col], near[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[place < k], col[place < k]
    return who[row], ids[col], d[row, col]


def visited(index: CellIndex, pairs: DataFrame, k: int, where: Column | None) -> DataFrame:
    """(query_id, key, distance) of the k nearest rows in each slice of a cell that a query visits; a block of queries and a slice meet in a task."""
    spark = pairs.sparkSession
    key, vector = index.key, index.vector
    asked = pairs.groupBy("cell").agg(F.max("slice").alias("s"), F.count("*").alias("n")).collect()
    if not asked:
        kind = dict(index.rows.dtypes)
        return spark.createDataFrame([], f"query_id {kind[key]}, {key} {kind[key]}, distance double")
    blocks = spark.createDataFrame([(r["cell"], -(-r["n"] // (BLOCK * (r["s"] + 1)))) for r in asked], "cell int, blocks int")
    rows = index.rows.where(F.col("cell").isin([r["cell"] for r in asked]))
    rows = rows if where is None else rows.where(where)
    rows = rows.select(key, vector, "cell", "slice").join(F.broadcast(blocks), "cell").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asking = pairs.join(F.broadcast(blocks), "cell").withColumn("b", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", key, "distance"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([left["query_id"].slice(0, 0), right[key].slice(0, 0), pa.array([], pa.float64())], names)
        ids, x, q = right[key].to_numpy(), unit(matrix(right[vector])), unit(matrix(left["qv"]))
        who, found = left["query_id"].to_numpy(), []
        step = max(1, (4 << 20) // len(ids))  # distances of 32 MB at once
        for lo in range(0, len(who), step):
            found.append(best_of(who[lo : lo + step], ids, 1 - q[lo : lo + step] @ x.T, k))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    group = ["cell", "slice", "b"]
    kind = dict(index.rows.dtypes)[key]
    return asking.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(ranked, f"query_id {kind}, {key} {kind}, distance double")


def search(index: CellIndex, queries: DataFrame, k: int, where: Column | None = None, prune: bool = True) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of each query (a table with the index's key and vector) among those that pass `where`; exact, ties by key at 12 decimals.

    With `prune` off every query visits every cell. Queries without length are as far from all rows: they get the least keys.
    """
    asked = queries.select(F.col(index.key).alias("query_id"), F.col(index.vector).alias("qv")).where("qv IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), index.key))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    pairs = written(routed(index, asked, k, False), "routes")
    first = written(best(visited(index, pairs, k, where)), "nearest")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    far = F.lit(float("inf"))
    reach = F.when((F.col("n") >= k) & F.lit(prune), F.sqrt(F.greatest(2 * F.col("d"), F.lit(0.0))) + 2 * SLACK).otherwise(far)
    within = asked.join(kth, "query_id", "left").select("query_id", "qv", F.coalesce(reach, far).alias("reach"))
    more = written(routed(index, within, k, True), "routes")
    return best(first.drop("rank").unionByName(visited(index, more, k, where)))


def read_share(index: CellIndex, queries: DataFrame, k: int) -> float:
    """The share of (query, row) pairs that a search compares, by the sizes of the cells that it visits."""
    asked = queries.select(F.col(index.key).alias("query_id"), F.col(index.vector).alias("qv"))
    first = search(index, queries, k).groupBy("query_id").agg(F.max("distance").alias("d"))
    within = asked.join(first, "query_id").select("query_id", "qv", (F.sqrt(2 * F.greatest("d", F.lit(0.0))) + 2 * SLACK).alias("reach"))
    pairs = routed(index, asked, k, False).unionByName(routed(index, within, k, True)).where("slice = 0").groupBy("cell").agg(F.count("*").alias("n")).collect()
    size = dict(zip(index.cells.tolist(), index.counts.tolist(), strict=True))
    return sum(r["n"] * size[r["cell"]] for r in pairs) / max(1, asked.count() * sum(size.values()))
