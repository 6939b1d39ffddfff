"""Cross-tokenizer alignment: tokens of two tokenizers as byte intervals, coalesced into the least groups that both cut alike.

All tokens of both sides are sorted by start and the ends accumulated by maximum; a group breaks where a start reaches the
running maximum. Inside a group every token of one side is linked with every token of the other. Neither tokenizer joins what
stands before a space with the space, so texts are cut there and the different pieces of a block are encoded and aligned once;
short ones that a task has met in earlier blocks are remembered.

Counts of id pairs are gathered over the whole corpus, added up in each task first. What is looked up in them again are the
pairs of each document: pairs above a share of all are a bounded table that every task holds, the others are joined.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from copy import copy
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table, written
from docloom.llm.textblock import spans, strings

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a block, linked pairs expanded at once, pairs held in a task while counting, and pairs at most that tasks hold as often met.
BLOCK, EXPANDED, HELD, OFTEN = 2 << 20, 1 << 22, 1 << 21, 1 << 18
#: Different pieces that a task remembers from block to block at most, and bytes of the longest of these.
REMEMBERED, REMEMBERED_BYTES = 1 << 17, 64
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: ids of texts, and the bytes of each id as flat arrays."""

    def __init__(self, words: list[bytes]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        return self.data[ragged(self.at[ids], self.size[ids])]


class ByteLevel(Side):
    """A byte-level BPE file; texts are encoded as they stand, strings of special tokens as plain text."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(file.decode())
        self.own.encode_special_tokens = True
        letters, words = byte_letters(), {i: t for t, i in self.own.get_vocab().items()}
        super().__init__([bytes(letters[c] for c in words[i]) if i in words and all(c in letters for c in words[i]) else words.get(i, "").encode() for i in range(max(words) + 1)])
        self.cuts = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Side):
    """A SentencePiece file, which puts a space before a text; byte pieces stand for their byte."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=file)
        words = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        super().__init__([bytes([int(w[3:5], 16)]) if self.own.is_byte(i) else w.replace(SPACE, " ").encode() for i, w in enumerate(words)])
        self.cuts = not any(SPACE in w.lstrip(SPACE) for w in words)  # no piece reaches from a letter over a space

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode([t[1:] for t in texts], num_threads=1)


@lru_cache(maxsize=4)
def load(kind: type[Side], file: bytes) -> Side:
    return kind(file)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), then those of start[1], and so on."""
    done = np.cumsum(size)
    return np.arange(int(done[-1]) if len(done) else 0) + np.repeat(start - (done - size), size)


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group of each interval, numbered from the left: sorted by start (then side), a group breaks where a start reaches the greatest end before it."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def cut_starts(raw: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where texts begin, and the spaces within them, but their last bytes, that follow something else than white space; raw has a space before each text."""
    before, second = np.concatenate([[32], raw[:-1]]), np.concatenate([[32, 32], raw[:-2]])[: len(raw)]
    # white space of two or three bytes ends in two bytes of which the first is one of these
    wide = (before >= 128) & ~np.isin(second, (0xC2, 0x80, 0x81, 0x9A))
    last = np.zeros(len(raw), bool)
    last[text_at[1:] - 1] = True  # a piece that is a lone space would be an empty text for side B
    at = np.flatnonzero((raw == 32) & ~last & (((before > 32) & (before < 127)) | wide))
    return np.union1d(at, text_at[:-1][np.diff(text_at) > 0])


class Aligned:
    """Different pieces of text, encoded by both sides: whether both spell them, and for each piece its groups, links, id pairs and digest text."""

    def __init__(self, a: Side, b: Side, texts: pa.Array):
        raw, at = strings(texts)
        raw, at = raw[at[0] : at[-1]], at - at[0]
        words, n = texts.to_pylist(), len(texts)
        sides = []
        for s in (a, b):
            ids = s.encode(words)
            count = np.fromiter(map(len, ids), np.int64, n)
            sides.append((np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count))
        self.good = np.ones(n, bool)
        for s, (ids, count) in zip((a, b), sides, strict=True):
            owner = np.repeat(np.arange(n), count)
            self.good &= np.bincount(owner, s.size[ids], n) == np.diff(at)
            same = self.good[owner]
            spelt, piece = s.spell(ids[same]), np.flatnonzero(self.good)
            differ = spelt != raw[ragged(at[piece], np.diff(at)[piece])]
            self.good[np.unique(np.repeat(piece, np.diff(at)[piece])[differ])] = False
        keep = [np.repeat(self.good, count) for _, count in sides]
        ids = [i[k] for (i, _), k in zip(sides, keep, strict=True)]
        count = [np.where(self.good, c, 0) for _, c in sides]
        self.n_a, self.n_b = count
        size = [s.size[i] for s, i in zip((a, b), ids, strict=True)]
        end = [np.cumsum(x) for x in size]
        side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        group = coalesce(np.concatenate([e - x for e, x in zip(end, size, strict=True)]), np.concatenate(end), side)
        ga, gb = group[: len(ids[0])], group[len(ids[0]) :]
        n_groups = int(group.max()) + 1 if len(group) else 0
        in_a, in_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        owner = np.zeros(n_groups, np.int64)
        owner[ga] = np.repeat(np.arange(n), count[0])
        self.n_groups = np.bincount(owner, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, owner, in_a * in_b)
        self.digest(ids, in_a, in_b)
        self.pair_up(ids, ga, gb, owner, n, len(b.size))

    def digest(self, ids: list[np.ndarray], in_a: np.ndarray, in_b: np.ndarray) -> None:
        left, right = list(map(str, ids[0].tolist())), list(map(str, ids[1].tolist()))
        a_at, b_at = np.concatenate([[0], np.cumsum(in_a)]).tolist(), np.concatenate([[0], np.cumsum(in_b)]).tolist()
        groups = [
            f"{left[p]}|{right[r]}" if q == p + 1 and s == r + 1 else ",".join(left[p:q]) + "|" + ",".join(right[r:s])
            for p, q, r, s in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], strict=True)
        ]
        at = np.concatenate([[0], np.cumsum(self.n_groups)]).tolist()
        self.text = [";".join(groups[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]

    def pair_up(self, ids: list[np.ndarray], ga: np.ndarray, gb: np.ndarray, owner: np.ndarray, n: int, n_b: int) -> None:
        """pair (a * ids of B + b) and how often, by piece; ids that repeat in a group are counted before they are paired."""
        width = int(max(map(int, (i.max(initial=0) for i in ids)))) + 1
        (ka, ca), (kb, cb) = (np.unique(g * width + i, return_counts=True) for g, i in zip((ga, gb), ids, strict=True))
        a_group, b_group = ka // width, kb // width
        b_at = np.searchsorted(b_group, np.arange(len(owner) + 1))
        partners = np.diff(b_at)[a_group]
        parts, done, lo = [], np.cumsum(partners), 0
        while lo < len(ka):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + EXPANDED, "right")))
            j = ragged(b_at[a_group[lo:hi]], partners[lo:hi])
            i = np.repeat(np.arange(lo, hi), partners[lo:hi])
            parts.append(summed(owner[a_group[i]], ka[i] % width * n_b + kb[j] % width, ca[i] * cb[j]))
            lo = hi
        piece, self.pair, self.times = summed(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 3
        self.pair_at = np.searchsorted(piece, np.arange(n + 1))


class Memory:
    """What a task has aligned before: its first different pieces of no more than REMEMBERED_BYTES, up to REMEMBERED. Others are aligned again in each block."""

    def __init__(self, a: Side, b: Side):
        self.sides, self.words = (a, b), pa.array([], pa.large_string())
        self.known = Aligned(a, b, self.words)

    def look_up(self, words: pa.Array) -> tuple[Aligned, np.ndarray]:
        """Alignments, and the place among them of each of the different `words`."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        place[new] = len(self.words) + np.arange(int(new.sum()))
        fresh = words.filter(pa.array(new))
        made = Aligned(*self.sides, fresh)
        both, room = joined(self.known, made), REMEMBERED - len(self.words)
        if room > 0:
            learnt = np.flatnonzero(pc.binary_length(fresh).to_numpy() <= REMEMBERED_BYTES)[:room]
            self.known = joined(self.known, picked(made, learnt))
            self.words = pa.concat_arrays([self.words, fresh.take(pa.array(learnt))])
        return both, place


_BY_PIECE = ("good", "n_a", "n_b", "n_groups", "n_links")


def picked(x: Aligned, at: np.ndarray) -> Aligned:
    """The pieces `at` of x."""
    out = copy(x)
    for c in _BY_PIECE:
        setattr(out, c, getattr(x, c)[at])
    out.text = [x.text[i] for i in at.tolist()]
    width = np.diff(x.pair_at)[at]
    take = ragged(x.pair_at[:-1][at], width)
    out.pair, out.times, out.pair_at = x.pair[take], x.times[take], np.concatenate([[0], np.cumsum(width)])
    return out


def joined(x: Aligned, y: Aligned) -> Aligned:
    """The pieces of x, then those of y."""
    out = copy(x)
    for c in (*_BY_PIECE, "pair", "times"):
        setattr(out, c, np.concatenate([getattr(x, c), getattr(y, c)]))
    out.text, out.pair_at = x.text + y.text, np.concatenate([x.pair_at, y.pair_at[1:] + x.pair_at[-1]])
    return out


def summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The times of equal (owner, pair) added up, by owner and pair."""
    if len(owner) and 0 <= pair.min() and max(pair.max(), owner.max()) < 1 << 31:  # both in one number, which sorts faster
        key = owner.astype(np.int64) << 31 | pair
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first] >> 31, key[first] & ((1 << 31) - 1), np.add.reduceat(times[order], first)
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], pair[first], np.add.reduceat(times, first) if len(first) else times


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def align(docs: DataFrame, a_file: bytes, b_file: bytes, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[type[Side], type[Side]] = (ByteLevel, Pieces), digest: bool = False) -> DataFrame:
    """ALIGNED for each document: counts of tokens, groups and links, groups as `a1,a2|b1;a3|b2,b3` (their SHA-256 with `digest`), and its linked id pairs (A id * ids of B + B id, ascending) with their times.

    Side A encodes a space and the text, side B the text, before which it puts a space itself. Null and empty texts, and
    those that either side does not spell byte for byte, have no tokens: zeros, an empty string and empty arrays. Null and
    repeated ids and repeated rows are rows like any other; an empty table gives no rows; other columns are not read.
    Memory follows a block of 2 MB, or one text where one is longer.
    """
    a_var, b_var = (docs.sparkSession.sparkContext.broadcast(x) for x in (a_file, b_file))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(kinds[0], a_var.value), load(kinds[1], b_var.value)
        memory = Memory(a, b)
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in spans(offsets, BLOCK):
                size = np.diff(offsets[lo : hi + 1])
                padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), batch.column(1).slice(lo, hi - lo).cast(pa.large_string()), pa.scalar("", pa.large_string()))
                raw, at = strings(padded.filter(pa.array(size > 0)))
                raw, at = raw[at[0] : at[-1]], at - at[0]
                starts = cut_starts(raw, at) if a.cuts and b.cuts else at[:-1]
                bounds = np.append(starts, len(raw)).astype(np.int64)
                pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
                unique, place = memory.look_up(pieces.dictionary)
                piece = place[pieces.indices.to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *of_texts(unique, piece, np.searchsorted(starts, at), size > 0, digest)], schema=schema)

    return plain.mapInArrow(convert, ALIGNED)


def of_texts(unique: Aligned, piece: np.ndarray, first: np.ndarray, some: np.ndarray, digest: bool) -> list[pa.Array]:
    """The columns of ALIGNED but the first, from the pieces of each text that is not empty (`first` is where they begin)."""
    n, count = len(first) - 1, np.diff(first)
    owner = np.repeat(np.arange(n), count)
    bad = np.bincount(owner, ~unique.good[piece], n) > 0
    place = np.flatnonzero(some)
    out = np.zeros((4, len(some)), np.int64)
    for k, per in enumerate((unique.n_a, unique.n_b, unique.n_groups, unique.n_links)):
        total = np.zeros(n, np.int64)
        np.add.at(total, owner, per[piece])
        out[k, place] = np.where(bad, 0, total)
    groups = [""] * len(some)
    for t, at, lo, hi in zip(range(n), place.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        if not bad[t]:
            whole = ";".join([unique.text[p] for p in piece[lo:hi].tolist()])
            groups[at] = hashlib.sha256(whole.encode()).hexdigest() if digest else whole
    used = ~bad[owner]
    text, own, times = summed(owner[used], piece[used].astype(np.int64), np.ones(int(used.sum()), np.int64))
    width = (unique.pair_at[1:] - unique.pair_at[:-1])[own]
    take = ragged(unique.pair_at[:-1][own], width)
    text, pair, times = summed(np.repeat(place[text], width), unique.pair[take], unique.times[take] * np.repeat(times, width))
    at = pa.array(np.searchsorted(text, np.arange(len(some) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (pair, times)]
    return [*map(pa.array, out), pa.array(groups, pa.string()), *lists]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many rows of `aligned` hold each id pair. Tasks add up what they hold, so that different pairs are shuffled."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, much = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            all_keys = np.concatenate([keys, *waiting])
            weight = np.concatenate([counts, np.ones(len(all_keys) - len(keys), np.int64)])
            return summed(np.zeros(len(all_keys), np.int64), all_keys, weight)[1:]

        for batch in batches:
            flat = batch.column(0).flatten().to_numpy()
            waiting.append(flat)
            much += len(flat)
            if much >= HELD:
                keys, counts = fold()
                waiting, much = [], 0
                if len(keys) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in fold()], ["pair", "n"])

    return aligned.select("pairs").mapInArrow(convert, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, a_file: bytes, b_file: bytes, often: int = OFTEN, **columns) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for each document, as `align` has them (groups digested).

    The count of an id pair is the number of documents that hold it linked. n_best is the number of links whose count is the
    highest of their A id (ties included), count_sum the sum of counts over links. Of N pairs held by documents at most
    `often` can stand in more than N / often documents: these are broadcast, the others, which are hot nowhere, are joined.
    """
    spark = docs.sparkSession
    rows = written(align(docs, a_file, b_file, digest=True, **columns).withColumn("row", F.monotonically_increasing_id()), "aligned")
    n_b = len(load(columns.get("kinds", (ByteLevel, Pieces))[1], b_file).size)
    counts = written(pair_counts(rows), "counts").withColumn("a", F.expr(f"pair div {n_b}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = written(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "known")
    least = (known.agg(F.sum("n")).first()[0] or 0) // often + 1
    frequent = known.where(F.col("n") >= least).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    held = spark.sparkContext.broadcast([frequent[c].to_numpy()[order] for c in ("pair", "n", "best")])
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = held.value
        for batch in batches:
            at = batch.column(1).offsets.to_numpy().astype(np.int64)
            flat, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = at - at[0]
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            where = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            found = pairs[where] == flat if len(pairs) else np.zeros(len(flat), bool)
            out = np.zeros((2, len(at) - 1), np.int64)
            np.add.at(out[0], owner[found], times[found] * best[where[found]])
            np.add.at(out[1], owner[found], times[found] * n[where[found]])
            left = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~found], minlength=len(at) - 1))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(left, pa.array(x[~found])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), *lists], schema=schema)

    split = written(rows.select("row", "pairs", "times").mapInArrow(convert, "row long, n_best long, count_sum long, rare array<long>, times array<long>"), "split")
    rare = split.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    looked = rare.join(known.where(F.col("n") < least), "pair").select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = split.select("row", "n_best", "count_sum").unionByName(looked).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select(kept).join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), read_file(BYTE_LEVEL), read_file(PIECES)).withColumnRenamed("groups", "groups_sha256")
