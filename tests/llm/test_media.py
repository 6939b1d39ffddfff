import hashlib
import zlib

import numpy as np
import pytest

from docloom.llm import media as M


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 256, 64 * 256 + 1, 64 * 700])
def test_round_trip_and_sample_tables(n):
    payload = M.pad(bytes(i % 251 for i in range(n)))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
    data = memoryview(M.pack(payload))
    (t,) = M.tracks(data)
    assert M.read_samples(data, t) == payload
    assert (t["codec"], t["timescale"], t["ticks"]) == ("raw ", 8000, len(payload))
    assert np.flatnonzero(t["keyframe"]).tolist() == list(range(0, len(payload) // 64, 32))
    off = t["offset"]
    assert all(bytes(data[o : o + 64]) == payload[i * 64 : i * 64 + 64] for i, o in enumerate(off.tolist()))


def test_foreign_container_with_wide_boxes_unequal_samples_and_no_sync_table():
    samples = [b"abc", b"de", b"fghij", b"k"]
    stbl = M.box(b"stbl", M.full(b"stsd", (1).to_bytes(4, "big"), M.box(b"avc1", bytes(78))), M.table_of(b"stts", [[3, 10], [1, 20]]), M.table_of(b"stsc", [[1, 3, 1], [2, 1, 1]]), M.full(b"stsz", (0).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"".join(len(s).to_bytes(4, "big") for s in samples)), M.full(b"co64", (2).to_bytes(4, "big") + (24).to_bytes(8, "big") + (40).to_bytes(8, "big")))
    mdhd = M.full(b"mdhd", bytes(16) + (90).to_bytes(4, "big") + bytes(12))
    mdhd = mdhd[:8] + b"\1" + mdhd[9:]
    mdat = (1).to_bytes(4, "big") + b"mdat" + (16 + 30).to_bytes(8, "big") + bytes(8) + b"abcdefghij" + bytes(6) + b"k" + bytes(5)
    data = memoryview(mdat + M.box(b"moov", M.box(b"trak", M.box(b"mdia", mdhd, M.box(b"minf", stbl)))))
    (t,) = M.tracks(data)
    assert t["codec"] == "avc1" and t["timescale"] == 90 and t["ticks"] == 50 and t["keyframe"].all()
    assert M.read_samples(data, t) == b"abcdefghijk"
    assert M.tracks(memoryview(b"\0\0\0\5junk")) == [] and M.tracks(memoryview(b"")) == []


def fragmented():
    """Two fragments of one track: sizes in the run, then by the default; sync samples by flags."""
    word = lambda *xs: b"".join(x.to_bytes(4, "big") for x in xs)
    mdhd = M.full(b"mdhd", word(0, 0, 100, 0, 0))
    tkhd = M.full(b"tkhd", word(0, 0, 7, 0))
    stbl = M.box(b"stbl", M.full(b"stsd", word(1), M.box(b"mp4a", bytes(28))), M.table_of(b"stts", []), M.table_of(b"stsc", []), M.full(b"stsz", word(0, 0)), M.table_of(b"stco", []))
    moov = M.box(b"moov", M.box(b"trak", tkhd, M.box(b"mdia", mdhd, M.box(b"minf", stbl))), M.box(b"mvex", M.full(b"trex", word(7, 1, 25, 3, 0x10000))))
    trun = lambda at: M.full(b"trun", word(2, at), word(0), word(5, 2), flags=0x1 | 0x4 | 0x200)
    frag = lambda at: M.box(b"moof", M.full(b"mfhd", word(1)), M.box(b"traf", M.full(b"tfhd", word(7), flags=0x20000), trun(at)))
    one = frag(len(frag(0)) + 8) + M.box(b"mdat", b"helloHI")
    plain = lambda at: M.box(b"moof", M.box(b"traf", M.full(b"tfhd", word(7, 0), flags=0x20), M.full(b"trun", word(2, at), flags=1)))
    two = plain(len(plain(0)) + 8) + M.box(b"mdat", b"abcdef")
    return moov + one + two


def test_fragments():
    data = memoryview(fragmented())
    (t,) = M.tracks(data)
    assert M.read_samples(data, t) == b"helloHIabcdef"
    assert (t["codec"], t["timescale"], t["ticks"]) == ("mp4a", 100, 100)
    assert t["size"].tolist() == [5, 2, 3, 3] and t["keyframe"].tolist() == [True, False, True, True]


def test_damaged_containers_give_a_row_of_nulls(spark):
    whole = M.pack(M.pad(b"x" * 9000))
    at = whole.index(b"stts")
    bad = whole[: at + 8] + b"\xff\xff\xff\xff" + whole[at + 12 :]
    rows = [(1, whole), (2, bad), (3, None), (4, b""), (5, whole[:300]), (6, fragmented()), (None, whole)]
    got = {r.id: r for r in M.container_columns(spark.createDataFrame(rows, "k long, data binary"), "data", "k").collect()}
    assert len(got) == 7 and all(got[i].codec is None for i in (2, 3, 4, 5))
    assert got[1].codec == "raw" and got[None].keyframes == got[1].keyframes and len(got[1].keyframes) == 5
    assert all(whole[k.offset : k.offset + k.bytes] == b"x" * 64 for k in got[1].keyframes[:4])
    assert got[6].duration_s == 1.0 and [(k.offset, k.bytes) for k in got[6].keyframes][0][1] == 5
    rng = np.random.default_rng(1)
    for _ in range(300):  # any bytes changed: tables or nothing, no other error
        data = bytearray(whole[:700])
        data[int(rng.integers(len(data)))] = int(rng.integers(256))
        try:
            M.tracks(memoryview(bytes(data)))
        except M.Damaged:
            pass


def test_columns(spark):
    texts = ["héllo", None, "", "x" * 64, "y" * 100_000, "héllo"]
    df = spark.createDataFrame([(i if i else None, t, "n", 3) for i, t in enumerate(texts)], "doc_id long, text string, codec string, n_bytes int")
    got = {r.doc_id: r for r in M.media_columns(df).collect()}
    assert len(got) == 6
    for i, t in enumerate(texts):
        r, raw = got[i if i else None], (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        stored = M.pack(pay)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert len(r.keyframes) == -(-(len(pay) // 64) // 32)
        for k in r.keyframes:
            assert stored[k.offset : k.offset + k.bytes] in pay and k.bytes == 64
    assert got[None].feature == got[5].feature
    assert M.media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def word(*xs):
    return b"".join(x.to_bytes(4, "big") for x in xs)


def test_hostile_fields(spark):
    deep = b""
    for _ in range(1500):
        deep = M.box(b"moov", deep)
    empty_head = M.box(b"moov", M.box(b"trak", M.box(b"tkhd")))
    far = M.box(b"moov", M.box(b"trak", M.full(b"tkhd", word(0, 0, 7, 0)))) + M.box(b"moof", M.box(b"traf", M.full(b"tfhd", word(7), (2**64 - 1).to_bytes(8, "big"), flags=1), M.full(b"trun", word(1), word(5), flags=0x200)))
    wide = M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.box(b"minf", M.box(b"stbl", M.table_of(b"stsc", [[1, 1, 1]]), M.full(b"stsz", word(1, 1)), M.full(b"co64", word(1), b"\xff" * 8))))))
    long = M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.full(b"mdhd", word(0, 0, 1000, 0)), M.box(b"minf", M.box(b"stbl", M.table_of(b"stts", [[2**32 - 1, 2**32 - 1]] * 3))))))
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate((deep, empty_head, far, wide, long))], "k long, data binary")
    rows = {r["id"]: r for r in M.container_columns(df, "data", "k").collect()}
    assert all(rows[i]["track"] is None for i in range(4))
    assert rows[4]["duration_s"] == 3 * (2**32 - 1) ** 2 / 1000


def test_random_damage_is_read_or_refused():
    rng = np.random.default_rng(3)
    for whole in (M.pack(M.pad(b"x" * 9000)), fragmented()):
        tables = whole.find(b"mdat") if whole.find(b"mdat") > 400 else len(whole)
        for _ in range(1500):
            data = bytearray(whole)
            for _ in range(int(rng.integers(1, 5))):
                at = int(rng.integers(0, tables))
                data[at : at + int(rng.integers(1, 9))] = bytes(rng.choice([0, 1, 127, 255, int(rng.integers(0, 256))], int(rng.integers(1, 9))).astype(np.uint8))
            data = data[: int(rng.integers(1, len(data) + 1))] if rng.random() < 0.2 else data
            try:
                found = M.tracks(memoryview(bytes(data)))
            except M.Damaged:
                continue
            for t in found:
                key = t["keyframe"][: len(t["offset"])]
                assert (t["offset"] >= 0).all() and len(t["size"][: len(key)][key]) == key.sum()
                assert not t["timescale"] or t["ticks"] / t["timescale"] >= 0
