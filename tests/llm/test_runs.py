import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import SF

from docloom.llm.runs import block_runs, collapse_runs, lyndon_lengths, op13_runs, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, periods=4):
    """Every run by trying all starts and periods."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, periods * q) and not any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(w):
    return [next((k - i for k in range(i + 1, len(w)) if w[k:] < w[i:]), len(w) - i) for i in range(len(w))]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    line = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha(line), sha(" ".join(kept)))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_lyndon_lengths(letters):
    rng = random.Random(letters)
    for _ in range(300):
        w = [rng.randint(1, letters) for _ in range(rng.randint(1, 40))]
        assert lyndon_lengths(np.array(w)).tolist() == plain_lyndon(w)
        two = w + [0] + w[::-1]
        assert lyndon_lengths(np.array(two)).tolist() == plain_lyndon(w) + [1] + plain_lyndon(w[::-1])


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_every_exponent(letters):
    rng = random.Random(letters)
    for _ in range(200):
        w = [rng.randint(1, letters) for _ in range(rng.randint(0, 40))]
        assert [tuple(r) for r in runs_of(np.array(w, np.int64), 2, 2).tolist()] == plain_runs(w, 2, 2)


def test_runs_of_blocks_of_periodic_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randint(1, 4) for _ in range(rng.randint(0, 12))]
            for _ in range(rng.randint(0, 3)):
                root = [rng.randint(1, 4) for _ in range(rng.randint(1, 6))]
                w += (root * 9)[: rng.randint(0, 45)] + [rng.randint(1, 9) for _ in range(rng.randint(0, 5))]
            texts.append(w)
        word = np.array([x for w in texts for x in w], np.int64)
        text = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        at = np.cumsum([0, *map(len, texts)])
        assert [tuple(r) for r in block_runs(word, text).tolist()] == [(s + at[i], m, q) for i, w in enumerate(texts) for s, m, q in plain_runs(w)]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(expected(r["doc_id"], r["text"]) for r in rows if len(WORD.findall(r["text"] or "")) < 400)
    ids = {r[0] for r in want}
    got = op13_runs(spark, SF)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    all_rows = sorted(tuple(r) for r in got.collect())
    assert len(all_rows) == len(rows)
    assert [r for r in all_rows if r[0] in ids] == want


def test_odd_rows(spark):
    long = "x " * 30000 + "y"
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 5), (4, "a b " * 5), (4, "a b " * 5), (5, long), (6, "é ü " * 7 + "z"), (7, "a a a a a")]
    df = spark.createDataFrame([(i, t, 0, "q") for i, t in texts], "doc_id long, text string, runs int, h string")
    got = sorted(((r["doc_id"] or 0), r["n_words"], [tuple(x) for x in r["runs"]], r["top"] and tuple(r["top"]), r["collapsed"]) for r in collapse_runs(df).collect())
    ab = (10, [(0, 10, 2)], (0, 10, 2), "a b")
    assert got == sorted(
        [(1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""), (0, *ab), (4, *ab), (4, *ab), (5, 30001, [(0, 30000, 1)], (0, 30000, 1), "x y"), (6, 8, [(0, 7, 1)], (0, 7, 1), "é ü z"), (7, 5, [], None, "a a a a a")]
    )
    assert collapse_runs(df.limit(0)).count() == 0


def test_longer_text_of_many_runs():
    rng = random.Random(9)
    w = []
    while len(w) < 3000:
        root = [rng.randint(1, 30) for _ in range(rng.randint(1, 40))]
        w += (root * 8)[: rng.randint(1, len(root) * 8)]
    assert [tuple(r) for r in block_runs(np.array(w), np.zeros(len(w), int)).tolist()] == plain_runs(w)
