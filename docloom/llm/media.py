"""ISO media containers as columns: walk nested boxes, decode sample tables, store codec, duration and keyframe byte ranges.

`pack` stores a payload losslessly as the samples of one track (8-bit units, 64 to a sample); `tracks` reads any
container of this family (nested boxes, 32- and 64-bit box sizes, stts, stsc, stsz, stco or co64, stss, and the fragments'
moof, tfhd and trun with the defaults of trex) without decoding a payload; `read_samples` copies the samples' bytes out
again; `container_columns` describes a column of containers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
SAMPLE_BYTES, SYNC_EVERY, PER_CHUNK, TIMESCALE = 64, 32, 256, 8000
#: Boxes within boxes at most; real files have about ten.
DEEPEST = 64

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_samples long, keyframes array<struct<offset:long,bytes:long>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def table_of(kind: bytes, rows: np.ndarray | list) -> bytes:
    rows = np.asarray(rows)
    return full(kind, struct.pack(">I", len(rows)), rows.astype(">u4").tobytes())


def pad(data: bytes) -> bytes:
    """Zeros up to the next positive multiple of 64."""
    return data + bytes(max(SAMPLE_BYTES, -(-len(data) // SAMPLE_BYTES) * SAMPLE_BYTES) - len(data))


def pack(payload: bytes) -> bytes:
    """One `raw ` track of 8-bit units, 64 to a sample, 256 samples to a chunk, each 32nd a sync sample; no dates, so equal payloads give equal files."""
    n = len(payload) // SAMPLE_BYTES
    if len(payload) != n * SAMPLE_BYTES or not n:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    chunks = -(-n // PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = n * SAMPLE_BYTES
    stsc = [[1, PER_CHUNK, 1]] if n % PER_CHUNK == 0 else [[chunks, n % PER_CHUNK, 1]] if chunks == 1 else [[1, PER_CHUNK, 1], [chunks, n % PER_CHUNK, 1]]
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
    wide = length + (1 << 20) + 4 * n >= 1 << 32

    def moov(first: int) -> bytes:
        at = np.arange(chunks, dtype=np.int64) * (PER_CHUNK * SAMPLE_BYTES) + first
        offsets = full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if wide else table_of(b"stco", at)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            table_of(b"stts", [[n, SAMPLE_BYTES]]),
            table_of(b"stss", np.arange(1, n + 1, SYNC_EVERY)),
            table_of(b"stsc", stsc),
            full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            offsets,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, min(length, 0xFFFFFFFF), 0x55C4, 0))
        hdlr = full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0")
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, min(length, 0xFFFFFFFF), 0, 0, 0x100, 0), matrix, bytes(8), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, min(length, 0xFFFFFFFF), 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    mdat = 8 if length + 8 < 1 << 32 else 16
    first = len(head) + len(moov(0)) + mdat
    return head + moov(first) + box(b"mdat", payload)


class Damaged(ValueError):
    """A box that says more than it holds."""


def walk(data: memoryview, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, parents first. A size that runs past its parent ends the walk there."""
    left = [(lo, len(data) if hi is None else hi, path)]
    while left:
        lo, hi, path = left.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1 and lo + 16 <= hi:
            size, body = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end < body or end > hi:
            continue
        yield (*path, kind), body, end
        left.append((end, hi, path))
        if kind in NESTED:
            if len(path) >= DEEPEST:
                raise Damaged("boxes nested too deep")
            left.append((body, end, (*path, kind)))


def u32(data: memoryview, lo: int, hi: int, count: int, width: int = 1) -> np.ndarray:
    if count * width * 4 > min(hi, len(data)) - lo:
        raise Damaged("a table runs past its box")
    return np.frombuffer(data, ">u4", count * width, lo).astype(np.int64).reshape(count, width)


def number(data: memoryview, lo: int, hi: int, kind: str = ">I") -> int:
    if lo + struct.calcsize(kind) > min(hi, len(data)):
        raise Damaged("a field runs past its box")
    return struct.unpack_from(kind, data, lo)[0]


def bounded(place: int) -> int:
    """A place in a file, which no container has beyond 2**62."""
    if not 0 <= place < 1 << 62:
        raise Damaged("a place outside of any file")
    return place


def placed(t: dict) -> None:
    """Offsets of a track's samples from its chunk tables."""
    n, chunks, runs = len(t["size"]), t["chunks"], t["stsc"]
    per = np.zeros(len(chunks), np.int64)
    if len(runs) and len(chunks):
        first = runs[:, 0] - 1
        if (np.diff(first) <= 0).any() or first[0] < 0:
            raise Damaged("runs of chunks out of order")
        counts = np.diff(np.append(first, len(chunks)).clip(0, len(chunks)))
        per = np.concatenate([np.zeros(min(int(first[0]), len(chunks)), np.int64), np.repeat(runs[:, 1], counts)])
    if per.sum() > 8 * n + (1 << 20):
        raise Damaged("chunks of more samples than there are")
    if len(chunks) and ((chunks < 0) | (chunks >= 1 << 62)).any():
        raise Damaged("a chunk outside of any file")
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    before = np.concatenate([[0], np.cumsum(t["size"])])[:-1][: len(chunk)]
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    begin = before[np.minimum(first, max(0, len(before) - 1))] if len(before) else before
    t["offset"] = chunks[chunk] + before - begin[chunk] if len(chunk) else np.zeros(0, np.int64)
    sync = np.ones(n, bool)
    if t["sync"] is not None:
        sync = np.zeros(n, bool)
        sync[t["sync"][(t["sync"] >= 0) & (t["sync"] < n)]] = True
    t["keyframe"] = sync


def run_of(data: memoryview, lo: int, hi: int, head: dict, track: dict) -> None:
    """Adds the samples of a fragment's trun to their track; `head` is its tfhd."""
    flags, count = number(data, lo, hi) & 0xFFFFFF, number(data, lo + 4, hi)
    at = lo + 8
    if flags & 1:
        head["next"] = bounded(head["base"] + number(data, at, hi, ">i"))
        at += 4
    first = None
    if flags & 4:
        first, at = number(data, at, hi), at + 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    rows = u32(data, at, hi, count, len(fields)) if fields else np.zeros((count, 0), np.int64)
    if not fields and count > len(data):
        raise Damaged("a run of more samples than bytes")
    column = lambda f, default: rows[:, fields.index(f)] if f in fields else np.full(count, default, np.int64)
    ticks, size, mark = column(0x100, head["ticks"]), column(0x200, head["size"]), column(0x400, head["flags"])
    if first is not None and count:
        mark = mark.copy()
        mark[0] = first
    track["more"].append((head["next"] + np.concatenate([[0], np.cumsum(size)])[:-1], size, (mark & 0x10000) == 0))
    track["ticks"] += int(ticks.sum())
    head["next"] = bounded(head["next"] + int(size.sum()))


def tracks(data: memoryview) -> list[dict]:
    """Codec, timescale, duration and every sample's offset, size and sync flag, by track; Damaged where a box holds less than it says."""
    out: list[dict] = []
    defaults: dict[int, list[int]] = {}
    moof, head = 0, None
    for path, lo, hi in walk(data):
        kind = path[-1]
        if kind == b"trak":
            out.append({"id": len(out) + 1, "codec": "", "timescale": 0, "ticks": 0, "sync": None, "size": np.zeros(0, np.int64), "stsc": np.zeros((0, 3), np.int64), "chunks": np.zeros(0, np.int64), "more": []})
        elif kind == b"trex":
            ident, _, *rest = u32(data, lo + 4, hi, 5)[:, 0].tolist()
            defaults[ident] = rest
        elif kind == b"moof":
            moof = lo - (16 if lo >= 16 and bytes(data[lo - 16 : lo - 8]) == b"\0\0\0\1moof" else 8)
        elif kind == b"tfhd":
            flags, ident, at = number(data, lo, hi) & 0xFFFFFF, number(data, lo + 4, hi), lo + 8
            ticks, size, marks = defaults.get(ident, [0, 0, 0])
            head = {"id": ident, "base": moof, "ticks": ticks, "size": size, "flags": marks}
            if flags & 1:
                head["base"], at = bounded(number(data, at, hi, ">Q")), at + 8
            at += 4 if flags & 2 else 0
            for bit, name in ((8, "ticks"), (16, "size"), (32, "flags")):
                if flags & bit:
                    head[name], at = number(data, at, hi), at + 4
            head["next"] = head["base"]
        elif kind == b"trun" and head:
            track = next((t for t in out if t["id"] == head["id"]), None)
            if track:
                run_of(data, lo, hi, head, track)
        if not out or b"trak" not in path:
            continue
        t = out[-1]
        if kind == b"tkhd":
            t["id"] = number(data, lo + (20 if number(data, lo, hi, ">B") else 12), hi)
        elif kind == b"mdhd":
            t["timescale"] = number(data, lo + (20 if number(data, lo, hi, ">B") else 12), hi)
        elif kind == b"stsd" and number(data, lo + 4, hi):
            t["codec"] = bytes(data[lo + 12 : lo + 16]).decode("latin-1")
        elif kind == b"stts":
            runs = u32(data, lo + 8, hi, number(data, lo + 4, hi), 2)
            t["ticks"] = sum(n * each for n, each in runs.tolist())  # two numbers of 32 bits: their products pass 63
        elif kind == b"stss":
            t["sync"] = u32(data, lo + 8, hi, number(data, lo + 4, hi))[:, 0] - 1
        elif kind == b"stsz":
            each, n = number(data, lo + 4, hi), number(data, lo + 8, hi)
            if each and n > len(data):
                raise Damaged("more samples than bytes")
            t["size"] = np.full(n, each, np.int64) if each else u32(data, lo + 12, hi, n)[:, 0]
        elif kind == b"stsc":
            t["stsc"] = u32(data, lo + 8, hi, number(data, lo + 4, hi), 3)
        elif kind == b"stco":
            t["chunks"] = u32(data, lo + 8, hi, number(data, lo + 4, hi))[:, 0]
        elif kind == b"co64":
            pairs = u32(data, lo + 8, hi, number(data, lo + 4, hi), 2)
            t["chunks"] = (pairs[:, 0] << 32) + pairs[:, 1]
    for t in out:
        placed(t)
        if t["more"]:
            n = len(t["offset"])
            parts = [(t["offset"], t["size"][:n], t["keyframe"][:n]), *t["more"]]
            t["offset"], t["size"], t["keyframe"] = (np.concatenate(x) for x in zip(*parts, strict=True))
    return out


def read_samples(data: memoryview, track: dict) -> bytes:
    """The samples' bytes in order, neighbouring samples copied as one range."""
    offset, size = track["offset"], track["size"][: len(track["offset"])]
    if not len(offset):
        return b""
    cut = np.flatnonzero(offset[1:] != offset[:-1] + size[:-1]) + 1
    lo = offset[np.concatenate([[0], cut])]
    hi = (offset + size)[np.concatenate([cut - 1, [len(offset) - 1]])]
    return b"".join(bytes(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True))


def feature(track: dict) -> str:
    """Codec, timescale, ticks, samples, keyframes and a checksum of all keyframe ranges."""
    key = track["keyframe"][: len(track["offset"])]
    ranges = np.stack([track["offset"][key], track["size"][: len(key)][key]], 1)
    return f"{track['codec'].strip()};{track['timescale']};{track['ticks']};{len(track['size'])};{int(key.sum())};{zlib.crc32(ranges.astype('<i8').tobytes()):08x}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a container, reads that back and returns SCHEMA, a row for each document.

    Null texts are empty; an empty text has a payload of 64 zeros; ids may be null or repeated; other columns are
    not read; an empty table gives no rows. A text is held in memory with its container, one at a time.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                payload = pad(raw)
                stored = memoryview(pack(payload))
                track = tracks(stored)[0]
                back = read_samples(stored, track)
                key = track["keyframe"]
                rows.append(
                    (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE_BYTES:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(track), track["codec"].strip(), track["ticks"] / max(1, track["timescale"]), len(track["size"]), (track["offset"][key], track["size"][key]))
                )
            cols = list(zip(*rows, strict=True)) if rows else [()] * 11
            ranges = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(r[0]) for r in cols[10]])]).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(np.concatenate([r[i] for r in cols[10]] or [np.zeros(0, np.int64)])) for i in (0, 1)], ["offset", "bytes"]),
            )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), ranges], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(convert, SCHEMA)


def container_columns(df: DataFrame, data_col: str, id_col: str) -> DataFrame:
    """(id, track, codec, duration_s, n_samples, keyframes): a row for each track of each container, of any writer.

    A container that is null, empty, damaged or without tracks gives one row of nulls, and so does one nested deeper than
    DEEPEST boxes; ids may be null or repeated; an empty table gives no rows. Payloads are not decoded; a container is held
    in memory, one at a time. Durations are those of the media: edit lists (elst) are not applied, composition offsets
    (ctts) and segment indexes (sidx) are not read, as they change neither byte ranges nor sync samples.
    """
    kind = dict(df.dtypes)[id_col]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = tracks(memoryview(data.as_py() or b""))
                except Damaged:
                    found = []
                for i, t in enumerate(found):
                    key = t["keyframe"][: len(t["offset"])]
                    ranges = [{"offset": a, "bytes": b} for a, b in zip(t["offset"][key].tolist(), t["size"][: len(key)][key].tolist(), strict=True)]
                    rows.append((ident.as_py(), i, t["codec"].strip(), t["ticks"] / t["timescale"] if t["timescale"] else None, len(t["size"]), ranges))
                if not found:
                    rows.append((ident.as_py(), None, None, None, None, None))
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "track", "codec", "duration_s", "n_samples", "keyframes"])

    return df.select(id_col, data_col).mapInArrow(read, f"id {kind}, track int, codec string, duration_s double, n_samples long, keyframes array<struct<offset:long,bytes:long>>")


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    """The columns of each stored text; keyframe byte ranges as `offset:bytes`, comma-joined."""
    from docloom.llm.common import table

    done = media_columns(table(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws(":", k["offset"], k["bytes"])), ",")
    return done.withColumn("keyframe_ranges", ranges).drop("keyframes")
