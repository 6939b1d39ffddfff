"""Document fingerprints: MinHash by universal hash permutations over word shingles, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import setjoin
from docloom.llm.common import table, written
from docloom.llm.textblock import Block, mix, spans, strings

#: Permutations, words in a shingle, and the bands (of ROWS values) by which `near_classes` finds candidates.
PERMUTATIONS, SHINGLE, BANDS, ROWS = 128, 5, 25, 5
_SEED = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
_A = (_SEED[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEED[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)
EMPTY = np.uint32(0xFFFFFFFF)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation a * x + b mod 2**32 over shingle hashes; all EMPTY where there is none."""
    out = np.full(PERMUTATIONS, EMPTY)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        values = np.multiply.outer(_A, x[i : i + 2048])
        values += _B[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def signatures(texts: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """A row of PERMUTATIONS values for each text."""
    data, offsets = strings(texts)
    out = np.empty((len(texts), PERMUTATIONS), np.uint32)
    for lo, hi in spans(offsets):
        hashes, at = Block(data, offsets, lo, hi).shingles(k)
        for i in range(hi - lo):
            out[lo + i] = signature(hashes[at[i] : at[i + 1]])
    return out


def short(sig: np.ndarray) -> np.ndarray:
    """The low 16 bits of each value: what a fingerprint string holds and likeness is counted on."""
    return (sig & np.uint32(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal values, an estimate of the Jaccard similarity of the shingle sets; 1 for two texts without words."""
    return float((a == b).mean())


def ordered_ranges(docs: DataFrame, rows_each: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with `bucket` and `part`, ranges of the order (descending doc_id, null ids last, then hash of the text) of about `rows_each` rows, and `guests`: each range's successor row.

    Bounds are approximate quantiles of the ids and the ids that repeat for more than a range; such an id, and null, is
    cut into parts by hash. Bounds and the ranges' first rows are known to the driver: both are as many as there are
    ranges, 65536 at most.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("hash", F.xxhash64("text"))
    n = docs.count()
    rows_each = max(rows_each, -(-n // (1 << 16)))
    often = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_each).collect()}
    depth = max(4, min(16, int(np.ceil(np.log2(max(1, n) / rows_each + 1)))))
    count = (1 << depth) - 1
    shares = [(i + 1) / (count + 1) for i in range(count)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, min(100 * (count + 1), 1_000_000)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds) | {k for k in often if k is not None}, reverse=True)
    depth = len(bounds).bit_length()
    bounds += [-(1 << 63)] * ((1 << depth) - 1 - len(bounds))
    spark_bounds = F.array(*(F.lit(b) for b in bounds)) if len(bounds) < 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
    steps = F.array(*(F.lit(1 << (depth - 1 - i)) for i in range(depth)))
    place = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(spark_bounds, lo + step - 1) > F.col("doc_id"), lo + step).otherwise(lo)) if depth else F.lit(0)
    # an id that is a bound is the last of its range: what precedes it there is part 0
    parts = spark.createDataFrame([(k, -(-v // rows_each)) for k, v in often.items()], "often long, parts long")
    share = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 33)  # by the order of hashes, in 31 bits
    part = F.coalesce(F.shiftright(share * F.col("parts"), 31).cast("int") + 1, F.lit(0))
    ranged = docs.join(F.broadcast(parts), docs["doc_id"].eqNullSafe(parts["often"]), "left")
    ranged = ranged.select("doc_id", "text", "hash", F.when(F.col("doc_id").isNull(), F.lit(1 << 20)).otherwise(place).alias("bucket"), part.alias("part"))
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "hash")).alias("first")
    heads = sorted((r["bucket"], r["part"], r["first"]) for r in ranged.groupBy("bucket", "part").agg(first).collect()) if n else []
    before = [(*heads[i - 1][:2], None if f["down"] is None else ~f["down"], f["hash"]) for i, (_, _, f) in enumerate(heads)]
    wanted = spark.createDataFrame(before, "bucket int, part int, first long, first_hash long")
    guests = docs.join(F.broadcast(wanted), docs["doc_id"].eqNullSafe(wanted["first"]) & (docs["hash"] == wanted["first_hash"]))
    return ranged, guests.groupBy("bucket", "part", "doc_id", "hash").agg(F.min("text").alias("text"))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 4000) -> DataFrame:
    """OUT for each document: its fingerprint and that of the text whose last half is taken from the next document's start.

    Documents follow each other by descending id (repeated ids by a hash of the text, null ids last), the last one is
    followed by the first. Null texts are empty; texts without words have the fingerprint of an empty set, alike to each
    other only. An empty table gives no rows; a table of one row follows itself. Texts are shuffled once, by ranges of
    that order, and each range gets its successor's first row, so no window or task holds more than a range.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged, guests = ordered_ranges(plain, rows_each)
    cols = ["bucket", "part", "guest", "doc_id", "hash", "text"]
    rows = ranged.withColumn("guest", F.lit(0)).select(cols).unionByName(guests.withColumn("guest", F.lit(1)).select(cols))
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "guest", F.desc_nulls_last("doc_id"), "hash", "text")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen: range, whether a guest, id, text, values
        for batch in batches:
            _, offsets = strings(batch.column("text"))
            for lo, hi in spans(offsets):
                part = batch.slice(lo, hi - lo)
                own = short(signatures(part.column("text")))
                ranges = list(zip(part.column("bucket").to_pylist(), part.column("part").to_pylist(), strict=True))
                now = list(zip(ranges, part.column("guest").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), own, strict=True))
                line = now if held is None else [held, *now]
                held = line[-1]
                pairs = [(a, b) for a, b in zip(line, line[1:], strict=False) if a[0] == b[0] and not a[1]]
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                other = short(signatures(pa.array(edited, pa.string()))) if edited else []
                out = [
                    (a[2], len(a[3]), hashlib.sha256(e.encode()).hexdigest(), a[4].tobytes().hex(), s.tobytes().hex(), likeness(a[4], s), likeness(a[4], b[4]))
                    for (a, b), e, s in zip(pairs, edited, other, strict=True)
                ]
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return dealt.mapInArrow(convert, OUT)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each of the BANDS bands of ROWS values."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key ^ mix(sig[np.arange(BANDS) * ROWS + i].astype(np.uint64) + np.uint64(i << 32)))
    return key


def banded(base: DataFrame, prints: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """(id, h, m0, m1, size, tokens) of `base` (id, h, text): digests and size of the set of shingles of each text, and its band keys (none without words); with `prints`, `fp` too, what that makes of the texts."""
    names = ["id", "h", "m0", "m1", "size", "tokens", *(["fp"] if prints else [])]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(2))
            for lo, hi in spans(offsets):
                n = hi - lo
                h, owner = setjoin.different(*Block(data, offsets, lo, hi).shingles(SHINGLE))
                marks, size = setjoin.set_marks(h, owner, n)
                at = np.concatenate([[0], np.cumsum(size)])
                keys = [band_keys(signature(h[a:b])).view(np.int64) if b > a else np.zeros(0, np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *map(pa.array, marks), pa.array(size), pa.array(keys, pa.list_(pa.int64()))]
                cols += [prints(batch.column(2).slice(lo, n))] if prints else []
                yield pa.RecordBatch.from_arrays(cols, names)

    return base.select("id", "h", "text").mapInArrow(convert, "id long, h string, m0 long, m1 long, size long, tokens array<long>" + (", fp long" if prints else ""))


def near_classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of each document: the least id that it reaches over links between texts whose shingle sets have at least `similarity` in common.

    Equal sets are one node. Nodes meet in the buckets of their signature bands, and every link is verified on the whole
    sets (`setjoin`). Null texts count as empty; texts without words are near copies of each other only. Null ids keep
    their row and name a class only if no member has an id; repeated rows stay rows; an empty table gives no rows; other
    columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.sha1("text"))
    rows = written(banded(base), "minhash")
    classes = setjoin.numbered(rows)
    joined = setjoin.joined_nodes(base, classes, SHINGLE, similarity)
    roots = classes.select("node", "m0", "m1", "size").join(joined, "node", "left").select("m0", "m1", "size", F.coalesce("root", "node").alias("root"))
    sets = ["m0", "m1", "size"]
    ids = rows.groupBy(*sets).agg(F.min("id").alias("least"))
    named = written(roots.join(ids, sets), "roots")
    by_set = named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").select(*sets, "class_id")
    return rows.select(*sets, F.col("id").alias("doc_id")).join(by_set, sets, "left").select("doc_id", "class_id")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def minhash_near_classes(spark, sf_dir: str) -> DataFrame:
    """The second half of the operator over all documents: bands joined, Jaccard verified."""
    return near_classes(table(spark, sf_dir, "documents"))


#: Sets of shingles by text, pairs by shared shingles, classes by the least id reached.
NEAR_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - {SHINGLE - 2})), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) AS s, len(w) AS n FROM d
), e AS (SELECT doc_id, len(s) AS size, unnest(s) AS shingle FROM g WHERE n > 0
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id > b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*))
), z AS (SELECT doc_id AS a, min(doc_id) OVER () AS b FROM g WHERE n = 0
), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT a, b FROM z
), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a
"""
