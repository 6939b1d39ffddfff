import base64
import hashlib
import struct

import pytest
import zstandard

from docloom.llm import warc as W
from docloom.llm.common import new_dir

SCHEMA = "page_id long, url string, html string, refers_to string, payload int"


def test_archive_round_trip_and_layout(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 20_000)
    big = "<p>" + "é long page " * 30_000 + "</p>"
    pages = [(i, f"http://h/{i}", f"<html>{i % 40}" + "text " * (i % 40) + "</html>", "x", 1) for i in range(200)]
    pages += [(300, None, None, "x", 1), (299, "http://a b\r\nX: y", "", "x", 1), (None, "u", "", "x", 1), (301, "u", big, "x", 1), (5, "again", pages[5][2], "x", 1), (None, "u", "only here", "x", 1)]
    df = spark.createDataFrame(pages, SCHEMA)
    folder = new_dir(spark, "warc")
    manifest = W.write_archives(df, folder)
    assert sum(r.records for r in manifest.collect()) == len(pages) and manifest.count() > 5
    rows = W.read_archives(manifest, folder).collect()
    assert len(rows) == len(pages)
    least = {}
    for i, _, h, *_ in pages:
        known = [x for x in (least.get(h or ""), i) if x is not None]
        least[h or ""] = min(known) if known else None
    want = sorted(
        str((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == least[h or ""] else "revisit", None if i == least[h or ""] else least[h or ""]))
        for i, _, h, *_ in pages
    )
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == want
    texts = {r.page_id: bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.page_id is not None}
    assert texts[301] == big and texts[299] == ""
    assert any(r.url == "http://a%20b%0D%0AX:%20y" for r in rows)


def test_small_payloads_are_not_deduplicated_below_the_limit(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "long enough", "", 0), (4, "u", "long enough", "", 0)], SCHEMA)
    folder = new_dir(spark, "warc")
    rows = W.read_archives(W.write_archives(df, folder, min_bytes=5), folder).collect()
    assert {r.page_id: r.record_type for r in rows} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_every_record_is_a_frame_behind_the_dictionary():
    records = [W.record(i, "http://h", f"<html>page {i} {'words ' * 50}</html>".encode(), None) for i in range(300)]
    data = W.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    d = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
    assert one.decompress(data[8 + size :]) == records[0]
    assert len(data) < sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records) + size
    assert [f["x-page-id"] for f, _ in W.read_archive(memoryview(data))] == [str(i) for i in range(300)]
    with pytest.raises(ValueError):
        list(W.read_archive(memoryview(data[:-3])))
    assert len(list(W.read_archive(memoryview(W.archive(records[:1]))))) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    folder = new_dir(spark, "warc")
    assert W.read_archives(W.write_archives(df, folder), folder).collect() == []
