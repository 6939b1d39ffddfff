"""SentencePiece encoding and decoding: the segmentation of highest total piece score, by a max-plus scan over chunks.

A text is read as `▁` + text with spaces as `▁`. Between two characters the state is the number of characters by
which the last piece reaches over; a chunk of a giant text thus is a matrix of best scores from entry to exit states.
Matrices are multiplied in the (max, +) semiring, associatively and in two levels; scores from the left and to the right
then give the state at every chunk boundary, and each chunk is backtraced on its own. Ordinary texts are one chunk.

Scores are held as integers in steps of 2**-16. Below them stands a fixed random value for each place in a word at which
a piece begins, which makes the best segmentation unique (the isolation lemma), so that it does not depend on where
chunks end. Characters in no piece become byte pieces.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table, written
from docloom.llm.textblock import mix, spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\ud800"  # a literal U+2581 of the text is held as a code point that no text has
CHUNK, FAN = 16384, 64
NEVER, UNIT = float("-inf"), 65536 << 52
EMPTY, ODD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str = MODEL, ranks: bool = True) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is piece, unscored, byte, unknown or other.

    Files of the unigram type have log probabilities as scores (ranks=False). Files of the BPE type have minus the rank of
    a piece there; the logarithm of its Zipf share, 1 / (rank + 2), then is the score, and longer pieces below all ranks have none.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)

    def one(i: int) -> tuple[str, float, str]:
        s = m.get_score(i)
        kind = "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "other" if m.is_control(i) or m.is_unused(i) else "piece"
        if ranks and kind == "piece":
            p = m.id_to_piece(i)
            s = s if s > -1e8 else -float(m.get_piece_size())
            return p, -math.log(2 - s), "unscored" if s == -m.get_piece_size() and len(p) > 1 else "piece"
        return m.id_to_piece(i), s, kind

    return [one(i) for i in range(m.get_piece_size())]


class Vocabulary:
    """Pieces as a lookup, with best segmentations of strings in which spaces are `SPACE`."""

    def __init__(self, rows: list[tuple[str, float, str]]):
        self.rows = rows
        self.unknown = next((i for i, r in enumerate(rows) if r[2] == "unknown"), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(rows) if k == "byte"}
        self.pieces = {p: (i, round(s * 65536) << 52) for i, (p, s, k) in enumerate(rows) if k == "piece"}
        self.lone = min((w for p, (_, w) in self.pieces.items() if SPACE not in p[1:]), default=0) - 10 * UNIT
        self.longest = max(map(len, self.pieces), default=1)
        self.ties: list[int] = []
        self.reach: dict[str, int] = {p[:2]: self.longest for p in self.pieces}
        # a piece that its parts beat is never used; if no other reaches over a space, words are independent
        for p in sorted((p for p in self.pieces if SPACE in p[1:]), key=len):
            own = self.pieces.pop(p)
            if self.best(p)[0] <= own[1]:
                self.pieces[p] = own
        self.by_word = not any(SPACE in p[1:] for p in self.pieces)
        self.reach: dict[str, int] = {}
        for p in self.pieces:
            self.reach[p[:2]] = max(self.reach.get(p[:2], 1), len(p))
        self.states = self.longest
        self.quick = self.by_word and max((-w >> 52 for _, w in self.pieces.values()), default=0) < 1 << 20
        if self.quick:
            self.build_trie()

    def ids_of_lone(self, c: str) -> list[int]:
        raw = (SPACE if c == LITERAL else c).encode()
        return [self.bytes.get(b, self.unknown) for b in raw] if self.bytes else [self.unknown]

    def forward(self, s: str, stop: int, place: int = 0) -> tuple[list, list[int]]:
        """Best scores from 0 to each end of a piece that starts before `stop`, and where that piece starts; s[0] is at `place` in its word."""
        n = len(s)
        best, came = [NEVER] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        get, reach, ties = self.pieces.get, self.reach.get, self.ties
        if len(ties) < place + n:
            ties += (mix(np.arange(len(ties), 2 * (place + n), dtype=np.uint64) + np.uint64(1)) >> np.uint64(33)).tolist()
        for i in range(min(stop, n)):
            at = best[i]
            if at == NEVER:
                continue
            at += ties[place + i]
            single = False
            for j in range(i + 1, min(n, i + reach(s[i : i + 2], 1)) + 1):
                found = get(s[i:j])
                if found is not None:
                    single |= j == i + 1
                    if at + found[1] > best[j]:
                        best[j], came[j] = at + found[1], i
            if not single and at + self.lone > best[i + 1]:
                best[i + 1], came[i + 1] = at + self.lone, i
        return best, came

    def path(self, s: str, came: list[int], end: int) -> list[int]:
        out: list[list[int]] = []
        while end > 0:
            i = came[end]
            found = self.pieces.get(s[i:end])
            out.append([found[0]] if found else self.ids_of_lone(s[i]))
            end = i
        return [x for part in reversed(out) for x in part]

    def best(self, s: str) -> tuple[int, list[int]]:
        best, came = self.forward(s, len(s))
        return best[len(s)], self.path(s, came, len(s))

    def build_trie(self) -> None:
        """All prefixes of pieces as nodes; steps (node, character) in an open-addressed table of arrays."""
        nodes, steps = {"": 0}, {}
        for p in self.pieces:
            for i in range(1, len(p) + 1):
                if p[:i] not in nodes:
                    nodes[p[:i]] = len(nodes)
                    steps[nodes[p[: i - 1]] << 21 | ord(p[i - 1])] = nodes[p[:i]]
        bits = max(4, (2 * len(steps)).bit_length())
        self.shift, keys = np.uint64(64 - bits), np.array(list(steps), np.uint64)
        slot, to = (keys * ODD) >> self.shift, np.array(list(steps.values()), np.int32)
        self.keys, self.to, self.probes = np.full(1 << bits, EMPTY, np.uint64), np.zeros(1 << bits, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            self.probes += 1
            at = slot[left].astype(np.int64)
            free = self.keys[at] == EMPTY
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.to[at[put]] = keys[left[put]], to[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + np.uint64(1)) & np.uint64((1 << bits) - 1)
        self.ends, self.quick_weight = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int64)
        for p, (i, w) in self.pieces.items():
            self.ends[nodes[p]], self.quick_weight[nodes[p]] = i, (w >> 52) << 37

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node, -1 where there is none."""
        key = (node.astype(np.uint64) << np.uint64(21)) | char.astype(np.uint64)
        at, out = ((key * ODD) >> self.shift).astype(np.int64), np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (found != EMPTY)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return out

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of words (each with the space before it) one after another, n + 1 offsets, and scores."""
        parts, counts, scores = [], [], []
        for i in range(0, len(words), 16384):
            ids, count, score = self.segment_some(words[i : i + 16384])
            parts.append(ids)
            counts.append(count)
            scores += score
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]), scores

    def segment_repeats(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Ids of words that may repeat, one after another, and the sum of their scores."""
        known: dict[str, int] = {}
        which = [known.setdefault(w, len(known)) for w in words]
        ids, at, scores = self.segment(list(known))
        return gathered(ids, at, np.array(which, np.int64)), sum(map(scores.__getitem__, which))

    def segment_some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """As `forward` and `path`, for many words of up to 64 characters at once: by start of piece, all words together."""
        n = np.array([len(w) if self.quick and len(w) <= 64 else 0 for w in words], np.int64)
        chars = np.frombuffer("".join(w for w, k in zip(words, n.tolist(), strict=True) if k).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), n)
        first = np.cumsum(n) - n
        place = np.arange(len(chars)) - np.repeat(first, n)
        end = np.repeat(first + n, n)
        # pieces that start at each character, found by walking the trie from all characters at once
        live, node, depth, found = np.arange(len(chars)), np.zeros(len(chars), np.int32), 0, []
        single = np.zeros(len(chars), bool)
        while len(live):
            node = self.step(node, chars[live + depth])
            live, node, depth = live[node >= 0], node[node >= 0], depth + 1
            hit = self.ends[node] >= 0 if len(node) else np.zeros(0, bool)
            found.append((live[hit], np.full(int(hit.sum()), depth), node[hit]))
            if depth == 1:
                single[live[hit]] = True
            more = live + depth < end[live]
            live, node = live[more], node[more]
        lone = np.flatnonzero(~single)
        # the different characters in no piece, with their byte pieces; in place of a piece they stand as -2 - which
        odd, which = np.unique(chars[lone], return_inverse=True)
        spelt = [self.ids_of_lone(chr(c)) for c in odd.tolist()]
        wide = np.array([len(x) for x in spelt], np.int64)
        spelt = np.array([x + [0] * (4 - len(x)) for x in spelt], np.int32).reshape(-1, 4)
        start = np.concatenate([lone, *(f[0] for f in found)])
        size = np.concatenate([np.ones(len(lone), np.int64), *(f[1] for f in found)])
        nodes = np.concatenate([np.full(len(lone), -1, np.int32), *(f[2] for f in found)])
        weight = np.where(nodes >= 0, self.quick_weight[nodes], (self.lone >> 52) << 37) if len(start) else np.zeros(0, np.int64)
        piece = self.ends[nodes] if len(start) else np.zeros(0, np.int32)
        piece[: len(lone)] = -2 - which
        order = np.argsort(place[start].astype(np.uint8), kind="stable")
        start, size, weight, piece = start[order], size[order], weight[order], piece[order]
        cut = np.searchsorted(place[start], np.arange(65))
        self.forward("", 0, 128)
        slots = len(chars) + len(words)
        best, came, by = np.full(slots, np.iinfo(np.int64).min), np.zeros(slots, np.int64), np.full(slots, -1, np.int32)
        base = first + np.arange(len(words))
        best[base] = 0
        for r in range(64):
            a, b = cut[r], cut[r + 1]
            if a == b:
                break
            at = start[a:b] + word[start[a:b]]
            to, value = at + size[a:b], best[at] + weight[a:b] + self.ties[r]
            good = (best[at] > np.iinfo(np.int64).min) & (value > best[to])
            best[to[good]], came[to[good]], by[to[good]] = value[good], at[good], piece[a:b][good]
        # backwards, all words together
        now, who, steps = (base + n)[n > 0], np.flatnonzero(n > 0), []
        total = best[base + n]
        while len(now):
            steps.append((who, by[now]))
            now = came[now]
            on = now > base[who]
            now, who = now[on], who[on]
        width = lambda ids: np.where(ids >= 0, 1, wide[np.maximum(-2 - ids, 0)]) if len(wide) else np.ones(len(ids), np.int64)
        count = np.zeros(len(words), np.int64)
        for w, ids in steps:
            count[w] += width(ids)
        scores = [((t >> 37) << 52) + (t & ((1 << 37) - 1)) for t in total.tolist()]
        kept = {}
        for i in np.flatnonzero(n == 0).tolist():
            scores[i], kept[i] = self.best(words[i])
            count[i] = len(kept[i])
        offset = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        until = offset + count
        for w, ids in steps:
            size = width(ids)
            until[w] -= size
            out[until[w]] = ids
            for i in np.flatnonzero(ids < 0).tolist():
                out[until[w[i]] : until[w[i]] + size[i]] = spelt[-2 - ids[i], : size[i]]
        for i, ids in kept.items():
            out[offset[i] : offset[i] + len(ids)] = ids
        return out, count, scores

    def texts(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of whole texts; none for an empty one."""
        plain = lambda t: t.replace(SPACE, LITERAL) if SPACE in t else t
        texts = pa.array(texts, pa.large_string())
        if not self.by_word:
            return [np.array(self.best(SPACE + plain(t).replace(" ", SPACE))[1] if t else [], np.int32) for t in texts.to_pylist()]
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        ids, at, _ = self.segment([SPACE + plain(w) for w in words.dictionary.to_pylist()])
        which, cut = words.indices.to_numpy(), np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
        some = pc.binary_length(texts).to_numpy() > 0
        return [gathered(ids, at, which[cut[i] : cut[i + 1]] if some[i] else which[:0]) for i in range(len(texts))]

    def split(self, s: str, size: int) -> tuple[int, list[str], int]:
        """First and last place in a chunk that every segmentation cuts at, and the words between; -1 if there is none."""
        if not self.by_word:
            return -1, [], -1
        first, last = s.find(SPACE, 0, size), s.rfind(SPACE, 0, size)
        if first < 0:
            return -1, [], -1
        return first, [SPACE + w for w in s[first:last].split(SPACE)[1:]], last

    def matrix(self, s: str, size: int, place: int) -> np.ndarray:
        """Best scores from entry to exit state for the chunk s[:size], s[size:] being what pieces may reach into."""
        k = self.states
        first, words, last = self.split(s, size)
        out = np.full((k, k), NEVER, object)
        if first >= 0:
            best, _ = self.forward(s[last:], size - last)
            tail = [best[size - last + j] if size - last + j < len(best) else NEVER for j in range(k)]
            middle = self.segment_repeats(words)[1]
            for i in range(min(k, first + 1)):
                head = self.forward(s[i:first], first - i, place + i)[0][first - i]
                out[i] = [head + middle + t for t in tail]
        else:
            for i in range(min(k, size + 1)):
                best, _ = self.forward(s[i:], size - i, place + i)
                for j in range(k):
                    if size - i + j < len(best):
                        out[i, j] = best[size - i + j]
        return out

    def between(self, s: str, size: int, place: int, entry: int, leave: int) -> np.ndarray:
        """Ids of the best way through a chunk from one state to another."""
        first, words, last = self.split(s, size)
        if first < 0:
            part = s[entry:]
            return np.array(self.path(part, self.forward(part, size - entry, place + entry)[1], size - entry + leave), np.int32)
        head, tail = s[entry:first], s[last:]
        a = self.path(head, self.forward(head, len(head), place + entry)[1], len(head))
        b = self.path(tail, self.forward(tail, size - last)[1], size - last + leave)
        return np.concatenate([np.array(a, np.int32), self.segment_repeats(words)[0], np.array(b, np.int32)])

    @cached_property
    def spelling(self) -> list[bytes]:
        """The bytes of each piece."""
        return [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "other" else p.replace(SPACE, " ").encode() for p, _, k in self.rows]


_HELD: dict[tuple, Vocabulary] = {}


def held(key: tuple, rows: Broadcast) -> Vocabulary:
    """The vocabulary of this worker process, built once."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Vocabulary(rows.value)
    return _HELD[key]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    out = np.full((a.shape[0], b.shape[1]), NEVER, object)
    for k in range(a.shape[1]):
        out = np.maximum(out, a[:, k, None] + b[None, k, :])
    return out


def as_text(m: np.ndarray) -> list[str]:
    """Numbers of any size as a column holds them; empty for NEVER."""
    return ["" if x == NEVER else str(x) for x in m.ravel()]


def from_text(xs) -> np.ndarray:
    return np.array([int(x) if x else NEVER for x in xs], object)


def boundary_states(mats: DataFrame, states: int) -> DataFrame:
    """(key, chunk, entry, leave) of each chunk on the best way, from (key, chunk, matrix): products of FAN chunks, then scores from both ends over the products, then over the chunks of each product."""
    part = mats.withColumn("part", F.floor(F.col("chunk") / FAN).cast("long"))
    stack = lambda pdf: [from_text(m).reshape(states, states) for m in pdf["matrix"]]

    def sweep(ms: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        left, right = [start], [end]
        for m in ms:
            left.append(times(left[-1], m))
        for m in reversed(ms):
            right.append(times(m, right[-1]))
        return left, right[::-1]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in stack(pdf.sort_values("chunk")):
            out = m if out is None else times(out, m)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [pdf["part"].iloc[0]], "matrix": [as_text(out)]})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        none = np.full(states, NEVER, object)
        none[0] = 0
        left, right = sweep(stack(pdf), none[None, :], none[:, None])
        return pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "left": [as_text(x) for x in left[:-1]], "right": [as_text(x) for x in right[1:]]})

    def inside(pdf: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        left, right = sweep(stack(pdf), from_text(edge["left"].iloc[0])[None, :], from_text(edge["right"].iloc[0])[:, None])
        at = [max(range(states), key=(a.ravel() + b.ravel()).__getitem__) for a, b in zip(left, right, strict=True)]
        return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "entry": at[:-1], "leave": at[1:]})

    products = part.groupBy("key", "part").applyInPandas(product, "key string, part long, matrix array<string>")
    edges = products.groupBy("key").applyInPandas(ends, "key string, part long, left array<string>, right array<string>")
    return part.groupBy("key", "part").cogroup(edges.groupBy("key", "part")).applyInPandas(inside, "key string, chunk long, entry long, leave long")


def gathered(ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Rows `which` of ids, cut at `at`, one after another."""
    size = at[which + 1] - at[which]
    begin = np.cumsum(size) - size
    return ids[np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(at[which], size)] if len(which) else np.zeros(0, np.int32)


def as_lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """docs with `ids_col` array<int>, the piece ids of the whole text; all columns, whatever their names, and rows stay, a column of that name is replaced.

    Null and empty texts give an empty array. Texts above two chunks take the chunked way, equal ones once; repeated
    rows stay rows; an empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    rows = spark.sparkContext.broadcast(read_vocabulary(path))
    key_of = (path, os.path.getsize(path))
    vocabulary = held(key_of, rows)
    states, by_word = vocabulary.states, vocabulary.by_word
    chunk = max(chunk, 2 * states)
    docs = docs.drop(ids_col)
    size = F.coalesce(F.length(text_col), F.lit(0))

    @F.arrow_udf("array<int>")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held(key_of, rows)
        for texts in batches:
            data = texts.cast(pa.large_string()).fill_null("")
            at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
            for lo, hi in spans(at, 2 << 20):
                yield as_lists(v.texts(data[lo:hi]))

    small = docs.where(size <= 2 * chunk).withColumn(ids_col, whole(text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                n = len(t) + 1
                s = SPACE + t
                for at in range(0, n, chunk * FAN):
                    lo = range(at, min(n, at + chunk * FAN), chunk)
                    # the place of a chunk's start in its word; where pieces reach over spaces, in the text
                    place = [i if not by_word else 0 if s[i] == " " else i - max(0, s.rfind(" ", 0, i)) for i in lo]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(lo)), pa.array([i // chunk for i in lo], pa.int64()), pa.array([min(chunk, n - i) for i in lo], pa.int64()), pa.array(place, pa.int64()), pa.array([i == 0 for i in lo]), pa.array([s[i : i + chunk + states - 1] for i in lo], pa.string())],
                        ["key", "chunk", "size", "place", "first", "part"],
                    )

    def prepared(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
        for n, place, first, part in zip(*(batch.column(c).to_pylist() for c in ("size", "place", "first", "part")), strict=True):
            s = part[1:] if first else part
            yield ((SPACE if first else "") + s.replace(SPACE, LITERAL).replace(" ", SPACE)), n, place

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held(key_of, rows)
        for batch in batches:
            found = [as_text(v.matrix(s, n, place)) for s, n, place in prepared(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(found, pa.list_(pa.string()))], ["key", "chunk", "matrix"])

    def backtraced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held(key_of, rows)
        for batch in batches:
            states_of = zip(batch.column("entry").to_pylist(), batch.column("leave").to_pylist(), strict=True)
            ids = as_lists([v.between(s, n, place, a, b) for (s, n, place), (a, b) in zip(prepared(batch), states_of, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), ids], ["key", "chunk", "part_ids"])

    giants = docs.where(size > 2 * chunk).select(F.struct("*").alias("doc"), F.col(text_col).cast("string").alias("text"))
    giants = giants.withColumn("digest", F.sha2("text", 256))
    texts = giants.select("digest", "text").dropDuplicates(["digest"])
    chunks = written(texts.mapInArrow(cut, "key string, chunk long, size long, place long, first boolean, part string").repartition("key", "chunk"), "chunks")
    mats = written(chunks.mapInArrow(matrices, "key string, chunk long, matrix array<string>"), "matrices")
    found = chunks.join(boundary_states(mats, states), ["key", "chunk"]).mapInArrow(backtraced, "key string, chunk long, part_ids array<int>")
    joined = found.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part_ids"))), lambda x: x["part_ids"])).alias("found"))
    large = giants.join(joined, F.col("digest") == F.col("key")).select("doc.*", F.col("found").alias(ids_col))
    return small.unionByName(large)


def decode(df: DataFrame, path: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with `out_col`, the text of the ids: null for null, empty for none. A column of that name is replaced."""
    rows = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    key_of = (path, os.path.getsize(path))

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = held(key_of, rows).spelling.__getitem__
        for batch in batches:
            for lo in range(0, len(batch), 512):
                ids = batch[lo : lo + 512]
                at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                out = [b"".join(map(get, flat[a:b].tolist()))[1:].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.array(out, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return df.withColumn(out_col, texts(F.col(ids_col).cast("array<int>")))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text: (doc_id, n_chars, n_tokens, ids_hash, round_trip)."""
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
