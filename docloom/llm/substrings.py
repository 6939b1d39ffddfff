"""Suffix-array dedup by a difference cover: every byte inside a string of WINDOW bytes that also starts earlier is removed.

Suffixes need an order to a depth of WINDOW bytes only, in which equal ones meet. No table of all suffixes is made. Places
whose number in their document is in a difference cover modulo PERIOD are the sample: of two equal windows, the places at
some distance below PERIOD are both in it. Three exchanges, each dealt to buckets of which a task holds one at a time:

1. The sample is ranked by its first WINDOW - PERIOD + 1 bytes, its core; each rank gets its number of places.
2. Sample places of repeated rank, with all that windows over their core can hold: the windows of a place that has the same
   surroundings as an earlier one are repeats as a whole. Where a rank has other surroundings too, its windows stay open.
3. Suffixes that are open (these lie about the ends of repeats) are dealt to buckets and sorted to the full depth.

Ranks and the order inside buckets are those of hashes, since only ties count. Hashes of 96 bits and more decide ties; the 32
bits within a bucket of the first exchange only choose what is looked at. Each block of text sends a rank, surroundings or
suffix once, whatever it repeats, so that no bucket grows with the repeats of one string. Blocks are written bucketed by the
task that read them, and are joined with what buckets answer without being shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import new_dir, table, written
from docloom.llm.textblock import mix, spans, strings

#: Bytes of a string that counts as a repeat, and a perfect difference set modulo 57 of eight numbers.
WINDOW, PERIOD, COVER = 100, 57, (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes in a block, sample places in a bucket (about), and lots into which a task deals its blocks.
BLOCK, IN_BUCKET, SPREAD = 1 << 20, 1 << 20, 4
CORE, NULL_LAST = WINDOW - PERIOD + 1, (1 << 63) - 1
_R = 0x9E3779B97F4A7C15
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for r in (_R, pow(_R, -1, 1 << 64)):
        p = np.full(n, r, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


class Hashes:
    """64-bit hashes of any substrings of a block, from sums of letters times powers."""

    def __init__(self, data: np.ndarray):
        p, self.back = _powers(max(BLOCK, 1 << len(data).bit_length()) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_LETTER[data], p[: len(data)], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def of(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return mix((self.sums[to] - self.sums[at]) * self.back[at] + (to - at).astype(np.uint64))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of significance, so that leading zeros stand together."""
    return len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(k).reshape(n))
        at += n * size
    return out


def firsts(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal keys: a permutation that sorts by keys, then order; where groups begin in it; the group of each of its places."""
    n = len(keys[0])
    by = np.lexsort((*reversed(order), *reversed(keys)))
    fresh = np.ones(n, bool)
    if n:
        fresh[1:] = np.logical_or.reduce([k[by[1:]] != k[by[:-1]] for k in keys])
    return by, np.flatnonzero(fresh), np.cumsum(fresh) - 1


class Texts:
    """A block of documents: sample places, their ranks and surroundings."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, bits: int):
        self.ids, self.data, self.bits = ids, data, bits
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.hashes = Hashes(data)
        self.turn = np.empty(len(ids), np.int64)  # documents in the order of their ids
        self.turn[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        long = np.flatnonzero(sizes >= WINDOW)
        last = sizes[long] - CORE  # the last place of a core in each long document
        laps = last // PERIOD + 1
        lap = np.arange(int(laps.sum())) - np.repeat(np.cumsum(laps) - laps, laps)
        place = (lap[:, None] * PERIOD + np.array(COVER)).ravel()
        owner = np.repeat(np.repeat(long, laps), len(COVER))
        inside = place <= np.repeat(np.repeat(last, laps), len(COVER))
        self.owner = owner[inside]
        self.place = place[inside] + self.at[self.owner]
        core = self.hashes.of(self.place, self.place + CORE)
        self.rank, self.which, self.times = np.unique(core >> np.uint64(32 - bits), return_inverse=True, return_counts=True)

    def surroundings(self, some: np.ndarray) -> np.ndarray:
        """A hash of what windows over the cores of these sample places can hold, with the lengths on both sides."""
        p, o = self.place[some], self.owner[some]
        lo, hi = np.maximum(self.at[o], p - PERIOD + 1), np.minimum(self.at[o + 1], p + WINDOW)
        return mix(self.hashes.of(lo, p) * np.uint64(3) + self.hashes.of(p, hi) * np.uint64(5))

    def repeated(self, total: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of sample places of ranks with a `total` of two or more: the earliest of each surroundings, their hashes and numbers here; and all others."""
        some = np.flatnonzero(total[self.which] > 1)
        around, core = self.surroundings(some), self.which[some]
        by, begin, group = firsts((around, core), (self.turn[self.owner[some]], self.place[some]))
        first = by[begin]
        rest = np.ones(len(some), bool)
        rest[first] = False
        return some[first], around[first], np.diff(np.append(begin, len(by))), some[rest]

    def windows(self, place: np.ndarray) -> np.ndarray:
        """Which windows of the block hold the core of a sample place (in bytes of the block)."""
        o = np.searchsorted(self.at, place, "right") - 1
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, np.maximum(self.at[o], place - PERIOD + 1), 1)
        np.add.at(change, np.minimum(place, self.at[o + 1] - WINDOW) + 1, -1)
        return np.cumsum(change, out=change)[:-1] > 0

    def decided(self, resolved: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows known as repeats; open windows, the earliest of each content, and two hashes of it.

        `resolved` are places whose surroundings stand earlier in other blocks, `mixed` those whose rank has other surroundings.
        """
        local = np.flatnonzero(self.times[self.which] > 1)
        inside = self.place[self.repeated(self.times)[3]] if len(local) else self.place[:0]
        known = self.windows(np.concatenate([resolved, inside]))
        i = np.flatnonzero(self.windows(mixed) & ~known)
        left, right = self.hashes.of(i, i + WINDOW // 2), self.hashes.of(i + WINDOW // 2, i + WINDOW)
        key, check = mix(left * np.uint64(3) + right * np.uint64(5)), (mix(left + right * np.uint64(7)) >> np.uint64(32)).astype(np.uint32)
        turn = self.turn[np.searchsorted(self.at, i, "right") - 1]
        by, begin, _ = firsts((key, check), (turn, i))
        first = by[begin]
        known[i] = True
        known[i[first]] = False
        return known, i[first], key[first], check[first]

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.at, place, "right") - 1]


Sent = Iterator[tuple[int, bytes]]


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Sent:
    """(bucket, packed columns) of each bucket that has rows."""
    by = np.argsort(bucket, kind="stable")
    own = bucket[by]
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    if not len(own):
        return
    for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(by)).tolist(), strict=True):
        yield int(own[lo]), pack(*(c[by[lo:hi]] for c in columns))


def sent_ranks(t: Texts, answers: list) -> Sent:
    return dealt((t.rank >> np.uint64(32)).astype(np.int64), t.rank.astype(np.uint32), t.times.astype(np.uint32))


def totals(rows: list[bytes]) -> list[bytes | None]:
    """How often each rank of each block stands in all blocks, where that is more often than in one."""
    parts = [unpack(r, np.uint32, np.uint32) for r in rows]
    at = np.cumsum([0, *(len(p[0]) for p in parts)])
    _, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    times = np.concatenate([p[1] for p in parts]).astype(np.int64)
    total = np.minimum(np.bincount(which, times), 2**32 - 1).astype(np.uint32)[which]
    return [pack(total[a:b]) if (total[a:b] > times[a:b]).any() else None for a, b in zip(at[:-1], at[1:], strict=True)]


def sent_surroundings(t: Texts, answers: list) -> Sent:
    total, bucket = t.times.astype(np.int64), (t.rank >> np.uint64(32)).astype(np.int64)
    for _, b, data in answers:
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        total[lo:hi] = unpack(data, np.uint32)[0]
    first, around, times, _ = t.repeated(total)
    rank = t.which[first]
    return dealt((around >> np.uint64(64 - t.bits)).astype(np.int64), around, t.rank[rank].astype(np.uint32), t.ids[t.owner[first]], t.place[first].astype(np.uint32), times.astype(np.uint32), np.minimum(total[rank], 2**32 - 1).astype(np.uint32))


def settled(rows: list[bytes]) -> list[bytes | None]:
    """Two columns by block, place and whether resolved: places whose surroundings stand earlier, and of the others those whose rank has more than these surroundings."""
    parts = [unpack(r, np.uint64, np.uint32, np.int64, np.uint32, np.uint32, np.uint32) for r in rows]
    around, rank, doc, place, times, total = (np.concatenate(c) for c in zip(*parts, strict=True))
    block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    by, begin, group = firsts((around, rank), (doc, block, place))
    resolved = np.ones(len(by), bool)
    resolved[by[begin]] = False
    here = np.add.reduceat(times[by].astype(np.int64), begin)[group]
    mixed = np.zeros(len(by), bool)
    mixed[by] = total[by] > here
    return answered(block, len(parts), resolved | mixed, place, resolved.astype(np.uint8))


def answered(block: np.ndarray, n: int, some: np.ndarray, *columns: np.ndarray) -> list[bytes | None]:
    i = np.flatnonzero(some)
    at = np.searchsorted(block[i], np.arange(n + 1))
    return [pack(*(c[i[a:b]] for c in columns)) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]


def known_places(answers: list) -> tuple[np.ndarray, np.ndarray]:
    found = [unpack(data, np.uint32, np.uint8) for kind, _, data in answers if kind == 2]
    place, resolved = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.uint8))
    place = place.astype(np.int64)
    return place[resolved == 1], place[resolved == 0]


def sent_suffixes(t: Texts, answers: list) -> Sent:
    _, first, key, check = t.decided(*known_places(answers))
    return dealt((key >> np.uint64(64 - t.bits)).astype(np.int64), key, check, t.doc_of(first), first.astype(np.uint32))


def later(rows: list[bytes]) -> list[bytes | None]:
    """By block, the suffixes that are not the earliest of their content."""
    parts = [unpack(r, np.uint64, np.uint32, np.int64, np.uint32) for r in rows]
    key, check, doc, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    by, begin, _ = firsts((key, check), (doc, block, place))
    repeats = np.ones(len(by), bool)
    repeats[by[begin]] = False
    return answered(block, len(parts), repeats, place)


SENT = "bucket int, lot int, part int, data binary"


def blocks_of(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """(lot, part, ids, sizes, data): documents in blocks of `block` bytes, SPREAD lots for each task that reads, as a table bucketed by lot."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, part, held, much = TaskContext.get().partitionId() * SPREAD, 0, [], 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            sizes, data = np.concatenate([h[1] for h in held]), b"".join(h[2] for h in held)
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((first + part % SPREAD, part, ids.to_pylist(), sizes, data), kinds, strict=True)], ["lot", "part", "ids", "sizes", "data"])

        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in spans(offsets, block):
                size = int(offsets[hi] - offsets[lo])
                if held and much + size > block:
                    yield row()
                    part, held, much = part + 1, [], 0
                held.append((batch.column(0).slice(lo, hi - lo), np.diff(offsets[lo : hi + 1]), data[int(offsets[lo]) : int(offsets[hi])].tobytes()))
                much += size
        if held:
            yield row()

    rows = plain.mapInArrow(convert, "lot int, part int, ids array<long>, sizes array<long>, data binary")
    name = f"docloom_blocks_{uuid.uuid4().hex}"
    rows.write.bucketBy(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "lot").option("path", new_dir(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """blocks with `answers`, those (kind, bucket, data) that belong to each; the smaller side is shuffled to where the lots are."""
    if not answers:
        return blocks.select("*", F.lit(None).cast("array<struct<kind: int, bucket: int, data: binary>>").alias("answers"))
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    by_lot = every.groupBy("lot").agg(F.collect_list(F.struct("part", "kind", "bucket", "data")).alias("told")).hint("shuffle_hash")
    own = F.transform(F.filter("told", lambda x: x["part"] == F.col("part")), lambda x: F.struct(x["kind"].alias("kind"), x["bucket"].alias("bucket"), x["data"].alias("data")))
    return blocks.join(by_lot, "lot", "left").select("lot", "part", "ids", "sizes", "data", own.alias("answers"))


def texts_of(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, int, pa.Array, Texts, list]]:
    """Each block with its ids as they are and its answers."""
    for batch in batches:
        for i in range(batch.num_rows):
            lot, part, told = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(5)[i]
            ids = batch.column(2)[i].values
            data = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8)
            t = Texts(ids.fill_null(NULL_LAST).to_numpy(), batch.column(3)[i].values.to_numpy(), data, bits)
            yield lot, part, ids, t, [(x["kind"], x["bucket"], x["data"]) for x in told.as_py() or []]


def exchanged(blocks: DataFrame, kind: int, bits: int, send: Callable[[Texts, list], Sent], reply: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """(lot, part, kind, bucket, data): what `reply` makes of all that blocks `send` to a bucket, for each block; written."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, part, _, t, answers in texts_of(batches, bits):
            sent = list(send(t, answers))
            if sent:
                bucket, data = zip(*sent, strict=True)
                n = len(sent)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([lot] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(data, pa.binary())], ["bucket", "lot", "part", "data"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            found = [(lot, part, kind, now, told) for (lot, part, _), told in zip(rows, reply([r[2] for r in rows]), strict=True) if told is not None]
            cols = zip(*found, strict=True) if found else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (*(pa.int32(),) * 4, pa.binary()), strict=True)], ["lot", "part", "kind", "bucket", "data"])

        for batch in batches:
            for bucket, lot, part, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and rows:
                    yield done()
                    rows = []
                now = bucket
                rows.append((lot, part, data))
        if rows:
            yield done()

    sorted_rows = blocks.mapInArrow(out, SENT).repartition("bucket").sortWithinPartitions("bucket", "lot", "part")
    return written(sorted_rows.mapInArrow(back, "lot int, part int, kind int, bucket int, data binary"), f"answers{kind}")


SPANS = "array<struct<start: long, end: long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each document as UTF-8 bytes: what lies in a string of WINDOW bytes that also starts earlier is removed, in maximal `spans`; `kept` are the other bytes in a row.

    Earlier is in a document of smaller id or at a smaller place of the same one; rows of the same id follow each other in
    the order of reading, null ids come last. Strings lie within a document and are judged on the input, overlapping ones
    too. Null texts are empty, texts below WINDOW bytes stay whole; copies of a row lose all but the first; an empty table
    gives no rows; other columns are not read. `kept` is binary, as it may end within a character. Memory follows
    a block (1 MB), or a text where one is longer, and a bucket of about a million sample places.
    """
    blocks = blocks_of(docs, id_col, text_col, block)
    total = blocks.agg(F.sum(F.length("data").cast("long")).alias("n")).first()["n"] or 0
    bits = min(24, max(8, math.ceil(math.log2(total * len(COVER) / PERIOD / IN_BUCKET + 1))))
    ranked = exchanged(with_answers(blocks), 1, bits, sent_ranks, totals)
    places = exchanged(with_answers(blocks, ranked), 2, bits, sent_surroundings, settled)
    suffixes = exchanged(with_answers(blocks, places), 3, bits, sent_suffixes, later)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, t, answers in texts_of(batches, bits):
            known = t.decided(*known_places(answers))[0]
            for kind, _, data in answers:
                if kind == 3:
                    known[unpack(data, np.uint32)[0].astype(np.int64)] = True
            i = np.flatnonzero(known)
            change = np.zeros(len(known) + 1, np.int32)
            change[i] += 1
            change[i + WINDOW] -= 1
            gone = np.cumsum(change, out=change)[:-1] > 0
            before = np.concatenate([[False], gone[:-1]])
            before[t.at[:-1][t.at[:-1] < len(gone)]] = False
            start = np.flatnonzero(gone & ~before)
            after = np.concatenate([gone[1:], [False]])
            after[t.at[1:][t.at[1:] > 0] - 1] = False
            end = np.flatnonzero(gone & ~after) + 1
            removed = np.concatenate([[0], np.cumsum(gone)])[t.at]
            begin = np.searchsorted(start, t.at)
            own = t.at[np.searchsorted(t.at, start, "right") - 1]
            pairs = pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - own)], ["start", "end"])
            left = t.data[~gone]
            kept_at = (t.at - removed).tolist()
            kept = [left[a:b].tobytes() for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(t.at)), pa.array(np.diff(removed)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pairs), pa.array(kept, pa.binary())], schema=schema)

    return with_answers(blocks, places, suffixes).mapInArrow(convert, f"doc_id long, n_bytes long, n_removed long, spans {SPANS}, kept binary")


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
