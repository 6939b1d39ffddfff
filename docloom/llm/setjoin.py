"""Groups of texts by the Jaccard similarity of their shingle sets: tokens bring sets together, links are verified on whole sets.

Sets that have a token in common meet in that token's bucket. Small buckets give pairs, which are verified by a join.
In large ones whole sets are compared and only links that join what was apart come out, so that what is sent grows with
rows and not with pairs: first inside parts of the buckets of the first tokens, which contracts groups of near copies, then
in the buckets that still hold sets of different groups, by pairs of blocks, so that every pair of a bucket is compared.
No link is taken unverified, and none is left out because a row was reached before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, written
from docloom.llm.textblock import Block, mix, spans, strings

#: Rows up to which a bucket gives pairs; rows and bytes of shingles of a part or block of a larger one, in the mean; the tokens by which groups are contracted.
GROUP, SET_ROWS, SET_BYTES, FIRST = 8, 1024, 16 << 20, 2
#: Keys of documents (about 80 bytes each) that may be broadcast; more are shuffled, with the same result.
BROADCAST_NODES = 200_000
_SLACK, _COLUMNS = 1e-6, 4096


def different(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text) of each different shingle of each text, sorted by text, then shingle."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    by = np.lexsort((hashes, owner))
    h, o = hashes[by], owner[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def set_marks(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Two 64-bit digests of the set of each of n texts, from its different shingles, and its size."""
    size = np.bincount(owner, minlength=n)
    begin = np.cumsum(size) - size
    marks = []
    for seed in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(np.array([seed], np.uint64))), dtype=np.uint64)])
        marks.append((sums[begin + size] - sums[begin]).view(np.int64))
    return marks, size


def numbered(rows: DataFrame) -> DataFrame:
    """(node, k struct<id, h>, m0, m1, size, tokens) of each different set of `rows` (id, h, m0, m1, size, tokens): k names its least text."""
    classes = rows.groupBy("m0", "m1", "size").agg(F.min(F.struct("id", "h")).alias("k"), F.first("tokens").alias("tokens"))
    return written(written(classes, "sets").withColumn("node", F.monotonically_increasing_id()), "classes")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, with the bounds of the groups."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        t = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for key in keys:
            x = t.column(key).to_numpy()
            change |= x[1:] != x[:-1]
        edge = np.flatnonzero(change) + 1
        last = int(edge[-1]) if len(edge) else 0
        held = t.slice(last)
        if last:
            yield t.slice(0, last), np.concatenate([[0], edge])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def shared_tokens(classes: DataFrame) -> DataFrame:
    """(token, node, size, pos, rows, weight): the tokens that two sets or more have, with the number of those and of their shingles."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, ["token"]):
            rows = np.repeat(np.diff(bounds), np.diff(bounds))
            weight = np.repeat(np.add.reduceat(t.column("size").to_numpy(), bounds[:-1]), np.diff(bounds))
            keep = pa.array(rows > 1)
            yield from t.append_column("rows", pa.array(rows)).append_column("weight", pa.array(weight)).filter(keep).to_batches()

    entries = classes.select("node", "size", F.posexplode("tokens").alias("pos", "token")).select("token", "node", "size", F.col("pos").cast("long").alias("pos"))
    return entries.repartition("token").sortWithinPartitions("token").mapInArrow(shared, "token long, node long, size long, pos long, rows long, weight long")


def sets_of(base: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, set) of the given nodes: their different shingles, sorted. Up to BROADCAST_NODES of them are looked for where the texts are."""
    needed = classes.join(nodes, "node", "left_semi").select("node", F.col("k.id").alias("_id"), F.col("k.h").alias("_h"))
    needed = written(needed, "needed")
    known = needed.count() <= BROADCAST_NODES
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    wanted = base.join(F.broadcast(needed) if known else needed, same).groupBy("node").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in spans(offsets):
                h, owner = different(*Block(data, offsets, lo, hi).shingles(k))
                at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), own], ["node", "set"])

    return written(wanted.mapInArrow(sets, "node long, set array<long>"), "shingles")


def alike(flat: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets flat[at[i]:at[i + 1]] are similar enough: a matrix, from products of the 0/1 rows of the shingles that several have."""
    n, size = len(at) - 1, np.diff(at).astype(float)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count > 1
    place = np.cumsum(keep) - 1
    row, column = np.repeat(np.arange(n), np.diff(at)), column.ravel()
    used = keep[column]
    row, column = row[used], place[column[used]]
    common = np.zeros((n, n), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for lo in range(0, int(keep.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        part = np.zeros((n, min(_COLUMNS, int(keep.sum()) - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    return common >= similarity * (size[:, None] + size[None, :] - common.astype(float)) - _SLACK


def forest(near: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows whose links join all that `near` joins, beyond what `root` has joined: a row is set aside only when such a link, or its root, has reached it."""
    left, out = np.ones(len(near), bool), []
    for first in range(len(near)):
        if not left[first]:
            continue
        left[first], reached = False, [first]
        while reached:
            i = reached.pop()
            own = np.flatnonzero(left & (root == root[i]))
            left[own] = False
            new = np.flatnonzero(left & near[i])
            out += [(i, j) for j in new.tolist()]
            left[new] = False
            reached += own.tolist() + new.tolist()
    return out


def bucket_links(base: DataFrame, classes: DataFrame, shared: DataFrame, roots: DataFrame | None, k: int, similarity: float) -> DataFrame:
    """(a, b), a > b: verified links inside large buckets of `shared`.

    Without `roots`, rows of a bucket are compared inside its parts. With `roots` (node, root), which says what is joined
    already, buckets of one root are left out and all pairs of blocks of the others are compared.
    """
    met = shared.where(F.col("rows") > GROUP).select("token", "node", F.greatest(F.ceil(F.col("rows") / SET_ROWS), F.ceil(F.col("weight") * 8 / SET_BYTES)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node", "token"), "blocks").cast("int")
    if roots is None:
        met = met.select("token", "node", F.col("node").alias("root"), mine.alias("b0"), mine.alias("b1"))
    else:
        met = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = met.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
        met = met.join(apart, "token", "left_semi").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("token", "node", "root", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"))
    met = written(met, "met")
    dealt = met.join(sets_of(base, classes, met.select("node").distinct(), k), "node").select("token", "b0", "b1", "node", "root", "set")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, ["token", "b0", "b1"]):
            node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
            whole = t.column("set").combine_chunks()
            flat, at = whole.flatten().to_numpy(), np.concatenate([[0], np.cumsum(whole.value_lengths().to_numpy())])
            found = [np.zeros((0, 2), np.int64)]
            for lo, hi in zip(bounds, [*bounds[1:], t.num_rows], strict=True):
                if hi - lo > 1 and (root[lo:hi] != root[lo]).any():
                    near = alike(flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], similarity)
                    found.append(node[lo:hi][np.array(forest(near, root[lo:hi]), np.int64).reshape(-1, 2)])
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(x.max(1, initial=-1)), pa.array(x.min(1, initial=1 << 62))], ["a", "b"])

    return dealt.repartition("token", "b0", "b1").sortWithinPartitions("token", "b0", "b1", "node").mapInArrow(linked, "a long, b long").where("a > b").distinct()


def small_pairs(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a > b: the pairs of small buckets that `roots` (node, root) has not joined and whose sizes allow the similarity."""
    rows = shared.where(F.col("rows") <= GROUP).join(roots, "node", "left").select("token", "node", "size", F.coalesce("root", "node").alias("root"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, ["token"]):
            node, size, root = (t.column(n).to_numpy() for n in ("node", "size", "root"))
            n = np.diff(np.append(bounds, t.num_rows))
            of = np.repeat(np.arange(len(n)), n)
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, min(GROUP, len(node))):
                i = np.flatnonzero((of[:-d] == of[d:]) & (root[:-d] != root[d:]) & (np.minimum(size[:-d], size[d:]) >= similarity * np.maximum(size[:-d], size[d:]) - _SLACK))
                x.append(node[i])
                y.append(node[i + d])
            a, b = np.concatenate(x), np.concatenate(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(met, "a long, b long").distinct()


def joined_nodes(base: DataFrame, classes: DataFrame, k: int, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of each node of `classes` that a link joins to others: sets of shingles of k words of `base` (id, h, text) that share a token and are similar enough are linked, and the links `known` (a, b) hold as they stand."""
    shared = written(shared_tokens(classes), "shared")
    first = bucket_links(base, classes, shared.where(F.col("pos") < FIRST), None, k, similarity)
    first = first if known is None else first.unionByName(known)
    # what is joined goes on as a star about its root, which joins the same nodes as all its links: later components take a round or two
    star = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = written(components(first), "roots")
    rest = bucket_links(base, classes, shared, roots, k, similarity)
    roots = written(components(star(roots).unionByName(rest)), "roots")
    pairs = written(small_pairs(shared, roots, similarity), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    shingles = sets_of(base, classes, ends, k)
    left, right = (shingles.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    common, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    near = pairs.join(left, "a").join(right, "b").where(common >= similarity * (both - common)).select("a", "b")
    return components(star(roots).unionByName(near))
