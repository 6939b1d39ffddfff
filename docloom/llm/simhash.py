"""SimHash near-duplicates: pigeonring-filtered Hamming links between distinct fingerprints, then components.

A fingerprint has 64 bits, seen as a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, then
some segment starts a chain, round the ring, in which the first l segments together differ in at most l * 3 / 8 bits for
every l: in 0 bits up to l = 2, in at most 1 up to l = 5, in at most 2 up to l = 7. So a pair shares, at one of the 8
starts, 16 bits exactly and, since the next three segments hold one difference at most, one half of these 24 bits too:
a key of 28 bits and 16 keys for each fingerprint. Pairs that share a key pass the chain's budgets before the full check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import minhash, setjoin
from docloom.llm.common import components, table, written
from docloom.llm.textblock import Block, spans, strings

SEGMENTS, MOST = 8, 3
#: A bucket of more fingerprints is dealt out as pairs of blocks of about this many.
BLOCK_ROWS = 4096


def simhash_one(text: bytes, k: int) -> int:
    """The fingerprint of lower-cased words that are joined by single spaces; 0 without words."""
    if not text:
        return 0
    cut = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    start, end = np.concatenate([[0], cut + 1]), np.append(cut, len(text))
    n = max(1, len(start) - k + 1)
    lo, hi = start[:n].tolist(), end[min(k, len(start)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(lo, hi, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def prints(texts: pa.Array, k: int = 3) -> pa.Array:
    """The fingerprint of each whole text over shingles of k words, repeats included, as signed numbers."""
    data, offsets = strings(texts)
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in spans(offsets):
        b = Block(data, offsets, lo, hi)
        joined = b.bytes.copy()
        for i in range(b.n):
            s, e = b.start[b.first[i] : b.first[i + 1]], b.end[b.first[i] : b.first[i + 1]]
            if not len(s):
                continue
            if (s[1:] - e[:-1] == 1).all():
                joined[e[:-1]] = 32
                text = joined[s[0] : e[-1]].tobytes()
            else:
                text = b" ".join(b.bytes[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True))
            out[lo + i] = simhash_one(text, k)
    return pa.array(out.view(np.int64))


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): SimHash of the whole text over shingles of k words, repeats included."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), prints(batch.column(1), k)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(convert, "doc_id long, fp long")


def rotated(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x with segment `start` moved to the lowest byte."""
    s = (start * 8).astype(np.uint64)
    return np.where(s == 0, x, (x >> s) | (x << ((np.uint64(64) - s) & np.uint64(63))))


def chained(x: np.ndarray) -> np.ndarray:
    """Whether differences x, rotated to their start, keep every budget of the chain, the last being the full Hamming check."""
    ok = np.ones(len(x), bool)
    at = np.arange(len(x))
    for length in range(1, SEGMENTS + 1):
        part = x[at] & np.uint64((1 << (8 * length)) - 1)
        good = np.bitwise_count(part) <= length * MOST // SEGMENTS
        ok[at[~good]] = False
        at = at[good]
    return ok


def bucket_links(fp: np.ndarray, node: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links (node, node) of a spanning forest of one bucket: breadth first, each row compared with all that are not yet reached."""
    rot = rotated(fp, np.full(len(fp), start))
    left, out = np.arange(len(fp)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            x = rot[left] ^ rot[i]
            hit = np.bitwise_count(x & np.uint64((1 << 40) - 1)) <= 1
            hit[hit] = chained(x[hit])
            new = left[hit]
            out += [(int(node[i]), n) for n in node[new].tolist()]
            reached += new.tolist()
            left = left[~hit]
    return out


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a > b: links between nodes of `prints` (node, lane, fp) whose fingerprints of one lane differ in at most MOST bits; they join the same nodes as all such links do.

    Each fingerprint goes to 16 buckets by key, which are compared in numpy, sorted by key inside partitions. A bucket
    above BLOCK_ROWS is dealt out as pairs of its blocks, so that no task holds more than two blocks of it; every pair of
    its rows still meets. A larger bucket's links come out as a spanning forest, so what is sent grows with rows and not
    with pairs. Fingerprints of a lane are to be distinct unless different nodes may share one.
    """
    starts = F.explode(F.array(*(F.lit(i) for i in range(SEGMENTS)))).alias("start")
    rot = F.when(F.col("start") == 0, F.col("fp")).otherwise(F.expr("shiftrightunsigned(fp, start * 8) | shiftleft(fp, 64 - start * 8)"))
    whole = prints.select("node", "lane", "fp", starts).withColumn("rot", rot)
    # a key is the lane, the start (3 bits), the half (1), the 16 exact bits, the 12 bits of that half
    head = F.shiftleft(F.col("lane").cast("long") * 8 + F.col("start"), 29) + F.shiftleft(F.col("rot").bitwiseAND(F.lit(0xFFFF)), 12)
    half = lambda i: head + i * (1 << 28) + F.shiftright("rot", 16 + 12 * i).bitwiseAND(F.lit(0xFFF))
    keys = whole.select("node", "fp", F.explode(F.array(half(0), half(1))).alias("key"))
    hot = written(keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK_ROWS), "hot")
    dealt = (
        keys.join(hot, "key", "left")
        .withColumn("blocks", F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK_ROWS).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .select("key", "node", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    )
    pairs = dealt.select("key", "node", "fp", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"))
    sorted_pairs = pairs.repartition("key", "b0", "b1").sortWithinPartitions("key", "b0", "b1", "fp")

    def groups(cols: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        key, node, fp = cols[:3]
        size = np.diff(bounds)
        gid = np.repeat(np.arange(len(size)), size)
        small = np.repeat(size <= 8, size)
        start = (key >> 29) & 7
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # buckets of two to eight rows: row i and row i + d, all buckets at once
        for d in range(1, min(8, len(fp))):
            i = np.flatnonzero(small[:-d] & (gid[:-d] == gid[d:]))
            good = i[chained(rotated(fp[i] ^ fp[i + d], start[i]))]
            a.append(node[good])
            b.append(node[good + d])
        for g in np.flatnonzero(size > 8):
            lo, hi = bounds[g], bounds[g + 1]
            found = np.array(bucket_links(fp[lo:hi], node[lo:hi], int(start[lo])), np.int64).reshape(-1, 2)
            a.append(found[:, 0])
            b.append(found[:, 1])
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(n).to_numpy() for n in ("key", "node", "fp", "b0", "b1")]
            now[2] = now[2].astype(np.int64).view(np.uint64)
            cols = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[3][1:] != cols[3][:-1]) | (cols[4][1:] != cols[4][:-1])) + 1
            last = int(edge[-1]) if len(edge) else 0
            held = [c[last:] for c in cols]
            if last:
                yield groups([c[:last] for c in cols], np.concatenate([[0], edge]))
        if held is not None and len(held[0]):
            yield groups(held, np.array([0, len(held[0])]))

    return sorted_pairs.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id reachable over links of at most 3 bits.

    Equal fingerprints are one class, represented once; only distinct ones are compared. Null texts and texts without
    words have fingerprint 0 and link like any other. Null ids keep their row and never name a component unless no
    member has an id. Repeated rows stay rows; an empty table gives no rows; other columns are not read.
    """
    fps = written(fingerprints(docs, k, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(classes.select(F.col("fp").alias("node"), F.lit(0).alias("lane"), "fp")))
    roots = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = written(roots, "classes")
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = roots.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def print_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a > b: links that join the nodes of `classes` (node, m0, m1, size) as fingerprints of at most MOST differing bits do; `rows` (m0, m1, size, fp) has the fingerprints of each set."""
    sets = ["m0", "m1", "size"]
    ends = written(rows.select(*sets, "fp").distinct().join(classes.select("node", *sets), sets).select("node", "fp"), "prints")
    found = components(links(ends.select(F.col("fp").alias("node"), F.lit(0).alias("lane"), "fp").distinct()))
    rooted = ends.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("least"))
    return rooted.join(least, "root").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the least id, of each group of near copies; all columns stay.

    Texts whose fingerprints differ in at most MOST bits are linked, as in `near_duplicates`. These are close copies: at a
    Jaccard similarity of 0.8 fingerprints differ in 5 to 14 bits. So texts whose sets of five-word shingles have a
    Jaccard similarity of at least `similarity` are linked too: what fingerprints have not joined meets in the bands of the
    MinHash signature (25 bands of 5 values: a pair of similarity 0.8 meets with probability 0.99995), and these links are
    verified on the whole sets; pairs are passed over only if links join them already. Both kinds join groups. Equal sets
    enter once. Null texts count as empty, texts without words are near copies of each other, of rows of one id and text that with
    the least other columns stays, rows with a null id can't be named and all stay, columns may have any names, and an
    empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.sha1(text.cast("binary")).alias("h"), text.alias("text"))
    base = rows.where(F.col("id").isNotNull()).select("id", "h", "text")
    sets = written(minhash.banded(base, prints), "sets")
    classes = setjoin.numbered(sets)
    close = written(print_links(sets, classes), "close")
    joined = setjoin.joined_nodes(base, classes, minhash.SHINGLE, similarity, close)
    roots = classes.join(joined, "node", "left").select("k", F.coalesce("root", "node").alias("root"))
    kept = written(roots.groupBy("root").agg(F.min("k").alias("k")).select("k.id", "k.h"), "kept")
    # documents stay where they are, but for those to leave out and those of which one row is to be chosen
    keys = written(base.groupBy("id", "h").agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), ["id", "h"], "left").where("stays is null or n > 1"), "keys")
    out = keys.select("id", "h")
    once = rows.join(F.broadcast(out) if keys.count() <= setjoin.BROADCAST_NODES else out, ["id", "h"], "left_anti").select("doc")
    others = [F.col("doc")[c] for c in docs.columns if c not in (id_col, text_col)]
    first = Window.partitionBy("id", "h").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    again = rows.join(keys.where("stays"), ["id", "h"], "left_semi").withColumn("at", F.row_number().over(first)).where("at = 1").select("doc")
    return once.unionByName(again).select("doc.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
