"""Streams end where one batch ends."""

import pytest
from pyspark.sql import functions as F

from docloom.sources.versioned import Versioned
from docloom.streaming import incremental


def split(spark, tmp_path, rows, schema, parts=3):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").json(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def test_upsert_stream_equals_one_batch(spark, tmp_path):
    rows = [(i % 5, i, f"v{i}") for i in range(30)]
    stream = split(spark, tmp_path, rows, "k int, at int, v string")
    table = Versioned(spark, str(tmp_path / "table"), ["k"], buckets=4)
    q = incremental.upsert_stream(stream, table, ["at"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in table.rows().collect()) == [(k, f"v{25 + k}") for k in range(5)]
    last = table.manifest()["version"]
    if last > 2:  # two versions are kept, however many batches
        with pytest.raises(Exception, match="does not exist"):
            table.rows(last - 2)


def test_windowed_counts_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 6}:1{i % 5}:00", "a" if i % 2 else "b", float(i)) for i in range(24)]
    schema = "t string, kind string, value double"
    at = lambda df: df.withColumn("at", F.to_timestamp("t"))
    stream = incremental.windowed_counts(at(split(spark, tmp_path, rows, schema)), "at", "2 hours", ["kind"], "value", late="1 day")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = incremental.windowed_counts(at(spark.createDataFrame(rows, schema)), "at", "2 hours", ["kind"], "value")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_request_states(spark, tmp_path):
    rows = [(1, 1, "pending"), (1, 2, "answered"), (1, 3, "failed"), (2, 1, "pending")]
    stream = split(spark, tmp_path, rows, "id long, at int, status string", parts=1)
    q = incremental.request_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.status, r.changes) for r in spark.table("states").collect()} == {(1, "answered", 1), (2, "pending", 0)}


def test_windows_that_overlap(spark):
    rows = [(f"2024-01-01 0{i}:30:00", float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "t string, value double").withColumn("at", F.to_timestamp("t"))
    got = {r.window_start.strftime("%H:%M"): r.events for r in incremental.windowed_counts(df, "at", "2 hours", [], "value", slide="1 hour").collect()}
    assert got["00:00"] == 2 and got["05:00"] == 1 and sum(got.values()) == 12


def test_rounds_end_after_empty_ones(spark):
    rows = [("a", i, n) for i, n in enumerate([1, 0, 0, 2, 0, 0, 0, 5, 1])] + [("b", i, n) for i, n in enumerate([0, 0, 1, 0, 0])]
    df = spark.createDataFrame(rows, "c string, i int, n int")
    got = [(r.c, r.i) for r in incremental.until_empty(df, "c", F.col("n"), ["i"]).orderBy("c", "i").collect()]
    assert got == [("a", i) for i in range(7)] + [("b", i) for i in range(5)]
