"""Run modes as a stream, against the rule over a table."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.streaming import incremental, list_pages

PAGES = {1: ["a", "b"], 2: ["c", "d"], 3: ["k1", "k2"], 4: ["e", "k3"], 5: ["k1"], 6: ["k2", "k3"], 7: ["f"], 8: ["k1"]}
KNOWN = ["k1", "k2", "k3"]


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(list_pages.ListPages)
    (tmp_path / "pages").mkdir()
    for n, ids in PAGES.items():
        (tmp_path / "pages" / f"{n}.json").write_text(json.dumps(ids))
    (tmp_path / "known").write_text("\n".join(KNOWN))
    return lambda mode, each=3: spark.readStream.format("list_pages").options(pages=f"file://{tmp_path}/pages", known=f"file://{tmp_path}/known", mode=mode, pagesPerBatch=each).load()


def run(stream, path):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").start()
    q.processAllAvailable()
    q.stop()


@pytest.mark.parametrize("mode", ["full", "resume", "update"])
def test_modes_read_what_the_rule_says_and_nothing_twice(spark, source, tmp_path, mode):
    table = spark.createDataFrame([(n, ids, [i for i in ids if i in KNOWN]) for n, ids in PAGES.items()], "page int, ids array<string>, known array<string>")
    want = sorted((r.page, i) for r in incremental.pages_to_read(table, mode).collect() for i in r.ids)
    run(source(mode), tmp_path / mode)
    got = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / mode / "out")).collect()))
    assert got() == want
    # started again with a new page: a run that is over reads nothing, whatever its mode
    (tmp_path / "pages" / "9.json").write_text('["late"]')
    run(source(mode), tmp_path / mode)
    assert got() == want


def test_a_run_goes_on_where_it_was(spark, source, tmp_path):
    reader = list_pages.ListReader({"pages": f"file://{tmp_path}/pages", "known": f"file://{tmp_path}/known", "mode": "update", "pagesPerBatch": "2"})
    offset, seen = reader.initialOffset(), []
    while not offset["over"]:
        rows, after = reader.read(offset)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(offset, after))
        seen, offset = seen + rows, after
    assert [p for p, _ in seen] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 6] and offset == {"page": 6, "known": 2, "over": True}
    assert list(reader.read(offset)[0]) == []
    with pytest.raises(ValueError, match="mode"):
        list_pages.ListReader({"pages": "x", "mode": "other"})
    assert source("full").select(F.col("page")).isStreaming
