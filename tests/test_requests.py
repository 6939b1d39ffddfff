"""The life of requests on a stream, against the replay of a batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.streaming import requests

SCHEMA = "id long, status string, at timestamp, text string"
START = datetime(2024, 1, 1)


def event(i, status, hours, text=None):
    return (i, status, START + timedelta(hours=hours), text)


BATCHES = [
    [event(1, "created", 0), event(2, "created", 0.5), event(2, "answered", 0.6, "yes"), event(9, "answered", 0.1, "nobody asked")],
    [event(1, "failed", 1, "e" * 2500), event(1, "answered", 1.5, "too late"), event(2, "failed", 1.2, "again"), event(3, "created", 1.1)],
    [event(2, "created", 2), event(4, "created", 2.2), event(4, "answered", 2.3, "a"), event(4, "failed", 2.3, "b")],
    [event(5, "created", 30)],
    [event(1, "answered", 0.2, "behind the watermark"), event(6, "created", 31)],
    [event(6, "answered", 31.5, "last")],
]


@pytest.fixture
def changes(spark, tmp_path):
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    requests.use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = requests.request_changes(stream, "24 hours", "1 hour").writeStream.format("memory").queryName("requests").outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    yield [(r.id, r.status, r.text, r.settled_at) for r in spark.table("requests").collect()]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_equals_replay(spark, changes):
    last = {}
    for i, *rest in changes:
        last[i] = tuple(rest)
    assert [c[1] for c in changes if c[0] == 1] == ["pending", "failed", "expired"]
    assert [c[1] for c in changes if c[0] == 2] == ["pending", "expired"] or [c[1] for c in changes if c[0] == 2] == ["answered", "expired"]
    assert next(c for c in changes if c[:2] == (1, "failed"))[2] == "e" * 1000
    assert last[4][0] in ("answered", "expired") and 9 not in last
    every = spark.createDataFrame([e for b in BATCHES for e in b], SCHEMA)
    # behind the watermark, the late answer of request 1 is left out; it would not change a settled one anyway
    now = START + timedelta(hours=30.5)  # the last event less an hour
    got = {r.id: (r.status, r.settled_at) for r in requests.replayed(every.where("coalesce(text, '') NOT LIKE 'behind%'"), F.lit(now.isoformat(" ")).cast("timestamp"), "24 hours").collect()}
    assert {i: (s, at) for i, (s, _, at) in last.items()} == got


def test_replay_of_ties_and_empty_tables(spark):
    rows = [event(1, "created", 0), event(1, "failed", 1, "x" * 1500), event(1, "answered", 1, "y"), event(2, "answered", 0, "no"), event(3, "created", 5), event(3, "answered", 4, "before it was asked")]
    df = spark.createDataFrame(rows, SCHEMA)
    now = F.lit("2024-01-01 06:00:00").cast("timestamp")
    assert sorted((r.id, r.status, r.text) for r in requests.replayed(df, now).collect()) == [(1, "answered", "y"), (3, "pending", None)]
    assert requests.replayed(df.limit(0), now).count() == 0
