"""Bucketed, versioned tables: what is rewritten, lost jobs, replays, leases."""

import os
import time

import pytest
from pyspark.sql import functions as F

from docloom.sources import versioned
from docloom.sources.versioned import Versioned, leased
from docloom.streaming import incremental


def state(df):
    return {r.k: r.v for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t", ["k"], buckets=16)
    t.upsert(spark.range(500).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v")), batch=0)
    return t


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table.manifest()
    after = table.upsert(spark.createDataFrame([(3, "new"), (900, "more")], "k long, v string"), batch=1)
    assert 1 <= len(after["rewritten"]) <= 2
    same = {b for b in before["folders"] if before["folders"][b] == {str(k): v for k, v in after["folders"].items()}[b]}
    assert len(same) == 16 - len(after["rewritten"])
    assert state(table.rows()) == {i: str(i) for i in range(500)} | {3: "new", 900: "more"}
    assert state(table.rows(1)) == {i: str(i) for i in range(500)}
    table.upsert(spark.createDataFrame([(4, "x")], "k long, v string"))
    with pytest.raises(Exception, match="0000000001"):
        table.rows(1)


def test_replays_and_lost_jobs(spark, table, monkeypatch):
    update = spark.createDataFrame([(1, "a")], "k long, v string")
    with monkeypatch.context() as m:
        m.setattr(Versioned, "publish", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.upsert(update, batch=1)
    assert state(table.rows())[1] == "1" and table.manifest()["version"] == 1
    done = table.upsert(update, batch=1)
    assert table.upsert(update.withColumn("v", F.lit("again")), batch=1)["version"] == done["version"]
    assert state(table.rows())[1] == "a"
    used = {f.split("/")[1] for n in (1, 2) for f in table.manifest(n)["folders"].values()}
    assert set(os.listdir(table.path.removeprefix("file://") + "/data")) == used
    # a second writer that read the same version loses
    old = table.manifest(1)
    with pytest.raises(RuntimeError, match="by another"):
        table.publish(old)


def test_repeated_keys_nulls_and_orders(spark, table):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(ValueError, match="more than once"):
        table.upsert(twice)
    table.upsert(twice, order=["v"])
    table.upsert(spark.createDataFrame([(None, "n")], "k long, v string"))
    table.upsert(spark.createDataFrame([(None, "m")], "k long, v string"))
    assert state(table.rows())[1] == "b" and state(table.rows())[None] == "m" and table.rows().count() == 501


def test_refresh_rewrites_on_change_only(spark, table):
    version = table.manifest()["version"]
    assert table.refresh(spark.createDataFrame([(5, "5"), (777, "x")], "k long, v string"), "v")["version"] == version
    m = table.refresh(spark.createDataFrame([(5, "five", 2), (5, "no", 1), (6, None, 1)], "k long, v string, at int"), "v", order=["at"])
    assert m["version"] == version + 1 and len(m["rewritten"]) == 1
    assert state(table.rows()) == {i: str(i) for i in range(500)} | {5: "five"}
    with pytest.raises(ValueError, match="more than once"):
        table.refresh(spark.createDataFrame([(5, "a"), (5, "b")], "k long, v string"), "v")


def test_a_killed_writer_blocks_for_one_lease_only(spark, table, tmp_path):
    path = f"file://{tmp_path}/t"
    with leased(spark, path, 60) as first:
        with pytest.raises(RuntimeError, match="another writer holds"), leased(spark, path, 60):
            pass
        first.renew()
    with leased(spark, path, 0.5) as dead:
        table.lease = dead
        time.sleep(0.6)
        with leased(spark, path, 60) as alive:
            assert alive.token == dead.token + 1
            with pytest.raises(RuntimeError, match="no longer held"):
                table.upsert(spark.createDataFrame([(1, "late")], "k long, v string"))
            table.lease = alive
            table.upsert(spark.createDataFrame([(1, "alive")], "k long, v string"))
    assert state(table.rows())[1] == "alive"
    with leased(spark, path, 5) as again:
        assert again.token > alive.token
    assert versioned.last_lease(spark, path + ".lease")[1] == 0


def test_stream_of_upserts_equals_the_batch(spark, tmp_path):
    rows = [(i % 37, i, f"v{i}") for i in range(300)]
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part::3], "k long, at int, v string").coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema("k long, at int, v string").option("maxFilesPerTrigger", 1).json(source)
    table = Versioned(spark, f"file://{tmp_path}/t", ["k"], buckets=8)
    for _ in range(2):
        incremental.upsert_stream(stream, table, ["at"], str(tmp_path / "c")).awaitTermination()
    assert state(table.rows()) == {k: f"v{max(i for i in range(300) if i % 37 == k)}" for k in range(37)}
    assert table.manifest()["version"] == 3 and table.manifest()["batch"] == 2
