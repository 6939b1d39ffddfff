"""Blocks of texts as flat numpy arrays: bytes, word bounds and word hashes for a megabyte of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that the arrays made from them stay in cache and memory is bounded.
BLOCK_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """The n first odd multipliers of the hash of a word: a fixed sequence."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FIRST = multipliers(4096)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def spans(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes, a row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Block:
    """Texts lo..hi of a column: lower-cased bytes, word starts and ends, first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = True):
        self.n = hi - lo
        base = int(offsets[lo])
        self.raw = data[base : int(offsets[hi])]
        self.text_at = offsets[lo : hi + 1] - base
        word = ~_BLANK[self.raw]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1 if len(word) else np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate([edge, self.text_at[:-1]])) if len(word) else edge
        cuts = cuts[cuts < len(word)]
        ends = np.append(cuts[1:], len(word))
        keep = word[cuts] if len(word) else np.zeros(0, bool)
        self.start, self.end = cuts[keep], ends[keep]
        self.first = np.searchsorted(self.start, self.text_at)
        self.bytes = _LOWER[self.raw] if lower else self.raw

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: the sum of (byte + 1) times the multiplier of its place, mixed."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        longest = int(size.max())
        table = _FIRST if longest <= len(_FIRST) else multipliers(longest)
        place = np.arange(int(size.sum()), dtype=np.int64)
        begin = np.cumsum(size) - size
        place -= np.repeat(begin, size)
        at = place + np.repeat(self.start, size)
        value = (self.bytes[at].astype(np.uint64) + np.uint64(1)) * table[place]
        return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, texts one after another, and the n + 1 offsets of texts in them.

        A text of fewer words has one shingle, its whole sequence; a text without words has none.
        """
        words = self.word_hashes()
        count = np.diff(self.first)
        made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
        out = np.concatenate([[0], np.cumsum(made)])
        if not len(words):
            return np.zeros(0, np.uint64), out
        power = multipliers(k + 1)
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        rolled = np.zeros(len(words), np.uint64)
        for j in range(k):
            rolled += padded[j : j + len(words)] * power[j]
        at = np.arange(out[-1]) - np.repeat(out[:-1], made) + np.repeat(self.first[:-1], made)
        hashes = rolled[at]
        for i in np.flatnonzero((count > 0) & (count < k)):
            w = words[self.first[i] : self.first[i + 1]]
            hashes[out[i]] = (np.append(w, np.uint64(k - len(w))) * np.append(power[: len(w)], power[k])).sum(dtype=np.uint64)
        return mix(hashes), out
