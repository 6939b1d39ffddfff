import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import minhash as M


def grams(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def texts_of(seed, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["É", "😀x"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(30, 300))) for _ in range(n)]
    near = []
    for t in base[:15]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near


def test_edited_fingerprints_against_brute_force(spark):
    texts = texts_of(1) + ["", None, "x", "ab", "two words", "y" * 100_000]
    rows = [(i * 7 - 30, t, "n", 5) for i, t in enumerate(texts)] + [(None, "no id", "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, bucket int")
    got = {r.doc_id: r for r in M.edited_fingerprints(df, rows_each=7).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    assert len(got) == len(rows)
    for i, (d, t, *_) in enumerate(order):
        own, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (M.short(M.signatures(pa.array([x]))[0]) for x in (own, edited, nxt))
        assert r.fingerprint == a.tobytes().hex() and r.edited_fingerprint == b.tobytes().hex()
        assert (r.near_edited, r.near_next) == (M.likeness(a, b), M.likeness(a, c))


def test_one_row_follows_itself_and_an_empty_table_has_none(spark):
    r = M.edited_fingerprints(spark.createDataFrame([(1, "one two three")], "doc_id long, text string")).first()
    assert r.near_next == 1.0
    assert M.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likeness_estimates_jaccard():
    texts = texts_of(2)
    sig = M.short(M.signatures(pa.array(texts)))
    errors = []
    for i in range(15):
        a, b = grams(texts[i]), grams(texts[40 + i])
        errors.append(M.likeness(sig[i], sig[40 + i]) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.04 and max(map(abs, errors)) < 0.15
    assert M.likeness(sig[0], sig[1]) < 0.1
    blank = M.short(M.signatures(pa.array(["", " \n", None], pa.string())))
    assert (blank[0] == blank[1]).all() and (blank[0] == blank[2]).all() and M.likeness(blank[0], sig[0]) == 0


def classes_by_brute_force(rows):
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("rows_of_bucket", [8, 4096])
def test_near_classes_are_those_of_all_pairs(spark, monkeypatch, rows_of_bucket):
    from docloom.llm import setjoin

    for name in ("SET_ROWS", "BROADCAST_NODES", "_COLUMNS"):
        monkeypatch.setattr(setjoin, name, rows_of_bucket)
    texts = texts_of(3) + ["", None, " ", "one two", "One  two"]
    rng = random.Random(8)
    words = [f"v{rng.randrange(3000)}" for _ in range(200)]
    for _ in range(120):  # copies of one original, alike to it and seldom to each other
        own = list(words)
        for i in rng.sample(range(33), 4):
            own[6 * i] = f"new{rng.random()}"
        texts.append(" ".join(own))
    rows = [(1000 - i, t) for i, t in enumerate(texts + texts[:2])]
    rows += [(7, texts[0]), (7, texts[20]), (None, texts[1]), (None, "no other has this text"), (3, texts[2]), (3, texts[2])]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int")
    assert sorted(((r.doc_id, r.class_id) for r in M.near_classes(df).collect()), key=str) == classes_by_brute_force(rows)
    assert M.near_classes(df.limit(0)).collect() == []


def test_repeated_and_null_ids_are_cut_into_ranges(spark):
    texts = texts_of(4)
    rows = [(5 if i < 30 else None if i < 50 else i, t) for i, t in enumerate(texts)] + [(9, "a b"), (5, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, M.edited_fingerprints(df, rows_each=4000).collect()))
    assert whole == sorted(map(str, M.edited_fingerprints(df, rows_each=3).collect())) and len(whole) == len(rows)
    ranged, guests = M.ordered_ranges(df, 3)
    assert ranged.groupBy("bucket", "part").count().agg({"count": "max"}).first()[0] <= 15 and guests.count() == ranged.select("bucket", "part").distinct().count()
