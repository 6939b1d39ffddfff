"""Late rows, quotas on streams, the ledger of seen keys."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.streaming import incremental, ledger
from docloom.streaming.late import LateWindows, counted_stream
from docloom.streaming.ledger import Ledger


def stream_of(spark, tmp_path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


@pytest.mark.parametrize("slide", [None, "1 hour"])
def test_on_time_and_late_rows_make_the_batch_result(spark, tmp_path, slide):
    rng = random.Random(slide)
    rows = [(f"2024-01-01 {i // 4:02}:{i % 4 * 15:02}:00", rng.choice("ab"), None if i % 17 == 0 else float(i)) for i in range(92)]
    behind = [rows.pop(3), rows.pop(10)]
    batches = [rows[:30], rows[30:60] + behind[:1], rows[60:], behind[1:]]
    schema = "t string, kind string, value double"
    stream = stream_of(spark, tmp_path, batches, schema).withColumn("at", F.to_timestamp("t"))
    w = LateWindows(f"file://{tmp_path}/w", "at", "2 hours", ["kind"], "value", "3 hours", slide)
    for _ in range(2):
        w.start(stream, str(tmp_path / "c")).awaitTermination(240)
    late = w.late_rows(spark)
    assert late.select("at", "kind").distinct().count() == 2 and set(r.batch for r in late.collect()) == {1, 3}
    every = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("at", F.to_timestamp("t"))
    want = incremental.windowed_counts(every, "at", "2 hours", ["kind"], "value", slide=slide)
    got = w.corrected(spark)
    assert sorted(map(str, got.select("window_start", "kind", "events", "total").collect())) == sorted(map(str, want.collect()))
    on_time = w.table(spark).rows().agg(F.sum("events")).first()[0]
    assert on_time + late.count() == want.agg(F.sum("events")).first()[0]


def test_streams_end_at_quotas_and_after_empty_rounds(spark, tmp_path):
    rng = random.Random(4)
    rows = [("a" if i % 3 else "b", i, rng.random() < 0.4) for i in range(90)]
    schema = "c string, i int, ok boolean"
    stream = stream_of(spark, tmp_path, [rows[k : k + 25] for k in range(0, 90, 25)], schema)
    every = spark.createDataFrame(rows, schema)
    for name, options, want in (
        ("quota", {"quota": 7}, incremental.until_quota(every, "c", F.col("ok"), ["i"], 7)),
        ("empty", {"empties": 3}, incremental.until_empty(every, "c", F.col("ok").cast("int"), ["i"], 3)),
    ):
        q = counted_stream(stream, "c", F.col("ok"), ["i"], **options).writeStream.format("memory").queryName(name).outputMode("append")
        q.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(240)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("sent", [ledger.SENT, 0])
def test_ledger_passes_what_no_run_has_seen(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(ledger, "SENT", sent)
    book = Ledger(spark, f"file://{tmp_path}/l", ["k", "j"], buckets=4, bits=1 << 12)
    rows = spark.range(2000).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id")).alias("k"), (F.col("id") % 3).cast("string").alias("j"), F.lit("x").alias("one"))
    assert book.unseen(rows).count() == 2000 and book.passed_on(rows) == 0
    book.record(rows.where("k < 300"), 1)
    book.record(rows.where("k < 400 OR k IS NULL"), 2)
    book.record(rows, 2)  # the run is done: nothing changes
    left = book.unseen(rows)
    assert left.columns == rows.columns
    assert sorted(r.k for r in left.collect()) == [i for i in range(400, 2000) if i % 100]
    share = book.passed_on(rows)
    assert 0.2 < share < 0.5 and book.passed_on(rows.where("k < 400")) == 1
