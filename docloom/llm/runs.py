"""Periodic run detection: Lyndon arrays by Baier's grouping under both orders, their roots extended through LCE into runs.

A run is a maximal stretch of words with a smallest period. By the runs theorem each run has a root that is the longest
Lyndon word at its place, under the order of words or under its reverse. Grouping (the first phase of Baier's suffix
sorter) leaves every suffix with its longest Lyndon prefix as context, so it yields these words without a suffix array.
Longest common extensions come from names of all stretches of 2**k words, which are exact.

Runs of four periods or more repeat each of their three-word stretches three times: stretches of a text that do not are left
out before, which loses no run. Documents are independent; nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD, table
from docloom.llm.textblock import Block, mix, spans, strings

#: A run has at least LEAST words and PERIODS times its period.
LEAST, PERIODS = 6, 4
RUN = "struct<start: long, length: long, period: long>"


def lyndon_lengths(word: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each place, by grouping; zeros separate texts, are below all words and have length 1.

    Groups are stretches of a permutation of places, higher groups to the right, so a group is known by where it begins.
    From the highest group down, the members' nearest lower places before them join the group's context to their own as
    often as members point at them, and move up to a new group just above the one that they leave.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    heads = np.flatnonzero(np.diff(word[order], prepend=-1))
    ends = np.append(heads[1:], n)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    begins = np.repeat(heads, ends - heads)
    places, at, group = order.tolist(), inverse.tolist(), begins[inverse].tolist()
    end = dict(zip(heads.tolist(), ends.tolist(), strict=True))
    before, size = [-1] * n, [1] * n
    lowest = int((word == 0).sum())
    high = n
    while high > lowest:
        low = group[places[high - 1]]
        members = sorted(places[low:high])
        context, pointed = size[members[0]], Counter()
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0 and group[j] >= lowest:
                pointed[j] += 1
        for (_, old), moved in groupby(sorted(pointed, key=lambda j: (-pointed[j], group[j])), key=lambda j: (pointed[j], group[j])):
            last = top = end[old]
            moved = list(moved)
            for j in moved:
                top -= 1
                other, place = places[top], at[j]
                places[place], at[other], places[top], at[j] = other, place, j, top
                size[j] += pointed[j] * context
            end[old] = top
            end[top] = last
            for j in moved:
                group[j] = top
        high = low
    return np.array(size, np.int64)


class Extensions:
    """Longest common extensions of pairs of places of a sequence, to the right and to the left."""

    def __init__(self, word: np.ndarray):
        self.names, n = [np.unique(word, return_inverse=True)[1]], len(word)
        while 2 << (len(self.names) - 1) <= n:
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            pair = last[: len(last) - step].astype(np.int64) * (int(last.max()) + 1) + last[step:]
            self.names.append(np.unique(pair, return_inverse=True)[1])

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            some = np.flatnonzero(np.maximum(a, b) + done < len(names))
            done[some[names[a[some] + done[some]] == names[b[some] + done[some]]]] += 1 << k
        return done

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b are the same."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            some = np.flatnonzero(np.minimum(a, b) - done >= step)
            done[some[names[a[some] - done[some] - step] == names[b[some] - done[some] - step]]] += step
        return done


def runs_of(word: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least `least` words and `periods` >= 2 periods, by start and period.

    `word` has positive ids of words and zeros between texts; no run crosses a zero.
    """
    n = len(word)
    if not n:
        return np.zeros((0, 3), np.int64)
    apart = word.astype(np.int64)
    apart[word == 0] = int(word.max()) + 1 + np.arange(int((word == 0).sum()))
    common, found = Extensions(apart), []
    for order in (word, np.where(word > 0, int(word.max()) + 1 - word, 0)):
        period = lyndon_lengths(order)
        root = np.flatnonzero((word > 0) & (np.arange(n) + period <= n))
        period = period[root]
        left, right = common.left(root, root + period), common.right(root, root + period)
        length = left + period + right
        kept = length >= np.maximum(least, periods * period)
        found.append(np.stack([root - left, length, period], axis=1)[kept])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def likely(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word lies in a stretch in which all three-word stretches occur three times in the text; runs of four periods and six words lie in such stretches."""
    out = np.zeros(len(word), bool)
    if len(word) < LEAST:
        return out
    key = mix(mix(mix(text.astype(np.uint64)) + word.astype(np.uint64))[:-2] + mix(word[1:-1].astype(np.uint64)) * np.uint64(3) + mix(word[2:].astype(np.uint64)) * np.uint64(5))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    often = (count[inverse] >= 3) & (text[:-2] == text[2:])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
    for lo, hi in edge.reshape(-1, 2):
        if hi - lo >= LEAST - 2:
            out[lo : hi + 2] = True
    return out


def block_runs(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """runs_of for words of several texts, in places of `word`; `text` is the number of each word's text."""
    at = np.flatnonzero(likely(word, text))
    if not len(at):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero((np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])) + 1
    rows = runs_of(np.insert(word[at], cut, 0))
    place = np.insert(at, cut, -1)
    rows[:, 0] = place[rows[:, 0]]
    return rows


OUT = f"doc_id long, n_words long, runs array<{RUN}>, top {RUN}, collapsed string"


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """OUT for each document: its runs by start and period, that of greatest length / period (then least start, then least period; null without runs), and its text without words that repeat.

    Words are runs of anything but ASCII blanks and count from 0; of a run, the words after its first period go, and
    the others are joined by single spaces. Null and empty texts and texts of blanks have no words, no runs and an empty
    collapsed text. Null ids, repeated ids and repeated rows are rows like any other; an empty table gives no rows; other
    columns are not read. Texts are handled in blocks of a megabyte, or one at a time where one is longer.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("top", run), ("collapsed", pa.string())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in spans(offsets):
                b = Block(data, offsets, lo, hi, lower=False)
                size, count = b.end - b.start, np.diff(b.first)
                text = np.repeat(np.arange(hi - lo), count)
                ends = np.cumsum(size)
                from_word = np.repeat(b.start - (ends - size), size)
                packed = b.raw[np.arange(len(from_word)) + from_word]
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(packed)])
                word = column.dictionary_encode().indices.to_numpy().astype(np.int64) + 1 if len(size) else np.zeros(0, np.int64)
                rows = block_runs(word, text)
                change = np.zeros(len(word) + 1, np.int64)
                np.add.at(change, rows[:, 0] + rows[:, 2], 1)
                np.add.at(change, rows[:, 0] + rows[:, 1], -1)
                kept = np.cumsum(change)[:-1] == 0
                # bytes of the kept words, each but a text's last followed by a space
                wide = (size + 1)[kept]
                done = np.cumsum(wide)
                at = np.arange(int(done[-1]) if len(done) else 0) + np.repeat((ends - size)[kept] - (done - wide), wide)
                gaps = done - 1
                joined = packed[np.minimum(at, max(0, len(packed) - 1))] if len(packed) else np.zeros(0, np.uint8)
                joined[gaps] = 32
                left = np.bincount(text[kept], minlength=hi - lo)
                last = np.cumsum(left)
                bounds = np.concatenate([[0], done])[np.concatenate([[0], last])]
                texts = [joined[a : max(a, z - 1)].tobytes().decode("utf-8", "replace") for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                own: list[list[dict]] = [[] for _ in range(hi - lo)]
                for start, length, period in rows.tolist():
                    t = int(text[start])
                    own[t].append({"start": start - int(b.first[t]), "length": length, "period": period})
                top = [max(r, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"]), default=None) for r in own]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n_words": pa.array(count), "runs": own, "top": top, "collapsed": texts}, kinds)

    return plain.mapInArrow(convert, OUT)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, every tenth by crc32 of its id made periodic from one of its words on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))
    placed = chosen.select("doc_id", "text", "w", F.when(F.col("n") > 0, a).cast("int").alias("a"), F.when(F.col("n") > 0, p).cast("int").alias("p"))
    made = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(F.col("w"), F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents after planting, digested."""
    rows = collapse_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    exact = F.expr("top.length * 1000 div top.period").alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"), exact, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
