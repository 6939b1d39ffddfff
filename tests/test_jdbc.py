"""The log in a database: Derby, which comes with Spark."""

import pytest
from pyspark.sql import functions as F

from docloom.sources.jdbc import ChatLog, Database

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def db(spark, request):
    return Database(spark, f"jdbc:derby:memory:{request.node.name.replace('[', '').replace(']', '')};create=true", DRIVER)


def test_life_of_a_question(spark, db):
    with db.transaction() as c:
        db.execute(c, "CREATE TABLE student_questions (session_id VARCHAR(9), message VARCHAR(99), created_at TIMESTAMP)")
        db.execute(c, "INSERT INTO student_questions VALUES ('s', 'old one', TIMESTAMP('2020-01-01 00:00:00')), (NULL, 'newer', CURRENT_TIMESTAMP)")
    log = ChatLog(db)
    assert log.create("student_questions") == 2 and log.create("student_questions") == 0
    first = log.add("  why?  ", "s1", now=0)
    assert log.purged == 0
    assert [r.QUESTION for r in db.frame("chat_logs").where("STATUS = 'legacy'").collect()] == ["newer"]
    second, third = log.add("how?", None, now=10), log.add("who?", "s", now=20)
    assert first < second < third and log.purged == 0
    log.add("when?", None, now=4000)
    assert log.purged == 4000
    assert log.answered(first, "because", "m") and not log.failed(first, "late") and not log.answered(first, "again", "m")
    assert log.failed(second, "e" * 3000) and not log.answered(999, "x", None)
    rows = {r.ID: r for r in db.frame("chat_logs").collect()}
    assert (rows[first].STATUS, rows[first].ANSWER, rows[first].QUESTION) == ("answered", "because", "why?") and rows[first].ANSWERED_AT is not None
    assert rows[second].STATUS == "failed" and rows[second].ERROR == "e" * 1000 and rows[second].ANSWERED_AT is None
    # many at once: finished rows stay, an id that stands twice changes once
    outcomes = [(first, "failed", None, "no"), (third, "failed", None, "f" * 2000), (third, "answered", "me", None), (12345, "answered", "x", None)]
    assert log.settle(spark.createDataFrame(outcomes, "id long, status string, answer string, error string")) == 1
    rows = {r.ID: r for r in db.frame("chat_logs").collect()}
    assert rows[first].STATUS == "answered" and (rows[third].STATUS, rows[third].ANSWER) == ("answered", "me")
    assert [r.QUESTION for r in log.recent(2).collect()] == ["when?", "who?"]
    with pytest.raises(Exception, match="CHAT_LOGS"), db.transaction() as c:
        db.execute(c, "UPDATE chat_logs SET status = 'answered' WHERE id = ?", second)
        db.execute(c, "UPDATE chat_logs SET status = 'other'")
    assert {r.ID: r.STATUS for r in db.frame("chat_logs").collect()}[second] == "failed"


def test_batches_are_put_once(spark, db):
    one = spark.range(300).select(F.col("id"), (F.col("id") * 2).alias("v"))
    assert db.put(one, "facts", "id", 1) and not db.put(one.withColumn("v", F.lit(-1).cast("long")), "facts", "id", 1)
    assert db.put(spark.createDataFrame([(3, -3), (1000, 5)], "id long, v long"), "facts", "id", 2)
    got = {r.id: r.v for r in db.frame("facts").collect()}
    assert got == {i: 2 * i for i in range(300)} | {3: -3, 1000: 5}


def test_reads_are_cut_into_ranges_and_filters_are_pushed(spark, db):
    db.put(spark.range(500).select(F.col("id").alias("ID"), (F.col("id") % 7).alias("V")), "wide", "ID", 1)
    rows = db.scan("wide", "ID", rows_each=100)
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 500
    few = rows.where("V = 3 AND ID > 100").select("ID")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(V,3)" in plan and "GreaterThan(ID,100)" in plan and "PushedFilters" in plan
    assert few.count() == sum(i % 7 == 3 and i > 100 for i in range(500))
    assert db.scan("wide", "ID").rdd.getNumPartitions() == 1


def test_the_database_cuts_off_the_newest(spark, db):
    times = spark.range(200).select(F.col("id").alias("ID"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 50 * 3600).alias("MADE"))
    db.put(times, "times", "ID", 1)
    got = db.newest("times", "MADE", "ID", 7, "2023-11-15 00:00:00")
    assert [r.ID for r in got.collect()] == [199, 149, 99, 49, 198, 148, 98]
    assert "FETCH FIRST 7 ROWS ONLY" in got._jdf.queryExecution().executedPlan().toString()
