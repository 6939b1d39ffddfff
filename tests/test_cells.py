"""The cell index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import cells, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, gap string"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 16)) * 3
    x = middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.3
    x[100:160] = x[100]  # one vector many times
    x[200:204] = 0
    rows = [(i, [float(v) for v in np.float32(r)], i % 4, "g") for i, r in enumerate(x)] + [(2000, None, 1, "g")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), np.float32(x).astype(float)


def plain(x, ids, q, k):
    u = cells.unit(x)
    d = (1 - u[ids] @ cells.unit(q[None, :])[0]).round(12)
    return [int(ids[i]) for i in np.lexsort((ids, d))[:k]]


@pytest.mark.parametrize(("number", "slice_bytes", "block"), [(None, 16 << 20, 1024), (30, 2000, 3), (1, 16 << 20, 2)])
def test_search_is_exact_with_and_without_pruning(spark, table, monkeypatch, number, slice_bytes, block):
    monkeypatch.setattr(cells, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(cells, "BLOCK", block)
    df, x = table
    index = cells.build(df, cells=number)
    assert index.counts.sum() == 900 and (number != 30 or index.slices.max() > 1)
    queries = df.where("vec_id % 20 = 0 OR vec_id IN (101, 201)")
    got = {}
    for r in cells.search(index, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    asked = [i for i in range(900) if i % 20 == 0 or i in (101, 201)]
    assert got == {i: plain(x, np.arange(900), x[i], 5) for i in asked}
    same = cells.search(index, queries, 5, prune=False)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in same.collect()} == {(q, v, n + 1) for q, vs in got.items() for n, v in enumerate(vs)}


def test_filters_few_rows_and_shares(spark, table):
    df, x = table
    index = cells.build(df, cells=24)
    some = np.array([i for i in range(900) if i % 4 == 3 and i % 5])
    where = (F.col("label") == 3) & (F.col("vec_id") % 5 != 0)
    got = cells.search(index, df.where("vec_id % 60 = 0"), 7, where).orderBy("query_id", "rank").collect()
    for i in range(0, 900, 60):
        assert [r.vec_id for r in got if r.query_id == i] == plain(x, some, x[i], 7)
    one = cells.top_k(index, x[5].tolist(), 7, where)
    assert [r.vec_id for r in one.orderBy("distance", "vec_id").collect()] == plain(x, some, x[5], 7)
    assert one.columns == [*df.columns, "distance"]
    few = cells.search(index, df.where("vec_id = 40"), 10, F.col("vec_id").isin(3, 9)).collect()
    assert sorted(r.vec_id for r in few) == [3, 9]
    assert 0 < cells.read_share(index, df.where("vec_id % 50 = 7"), 5) < 0.5
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_empty_index_and_no_queries(spark, table):
    df, _ = table
    index = cells.build(df.limit(0))
    assert cells.search(index, df.where("vec_id = 1"), 3).count() == 0
    full = cells.build(df, cells=4)
    assert cells.search(full, df.limit(0), 3).count() == 0
    assert vectors.nearest(df.where("vec_id < 900"), df.where("vec_id = 7"), 2).count() == 2
