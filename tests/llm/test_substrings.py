import hashlib
import random

import numpy as np
from compare import SF

from docloom.llm.substrings import COVER, PERIOD, WINDOW, op12_suffix_dedup, pack, remove_repeats, unpack


def plain(docs, window=WINDOW):
    """By a set of all strings seen; rows in the order of their ids, null last."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1):
            s = raw[k : k + window]
            if s in seen:
                gone[k : k + window] = True
            seen.add(s)
        n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


def test_cover_meets_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_pack_round_trip():
    cols = [np.arange(5, dtype=np.uint32) * 70000, np.array([-1, 2, 3, 2**62, 5]), np.array([1, 0, 1, 0, 1], np.uint8)]
    assert all(np.array_equal(a, b) for a, b in zip(cols, unpack(pack(*cols), np.uint32, np.int64, np.uint8), strict=True))


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs)


def made_texts(seed, n=150):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abé ") for _ in range(k))
    base = [word(rng.randint(50, 400)) for _ in range(8)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            kind, b = rng.random(), rng.choice(base)
            if kind < 0.5:
                lo = rng.randint(0, len(b) // 2)
                t += b[lo : rng.randint(lo, len(b))]
            elif kind < 0.6:
                t += rng.choice("xy") * rng.randint(1, 300)
            elif kind < 0.7:
                t += (word(rng.randint(1, 9)) or "q") * rng.randint(1, 60)
            else:
                t += word(rng.randint(0, 200))
        out.append(t)
    return out


def test_made_texts_in_small_blocks(spark):
    for seed, block in ((1, 700), (2, 3000), (3, 1 << 20)):
        texts = made_texts(seed)
        docs = [*zip(random.Random(seed).sample(range(1000), len(texts)), texts, strict=True), (None, texts[3] + texts[5]), (2000, None), (2001, ""), (2002, "x" * 99), (2003, "y" * 5000), (2004, texts[7]), (2005, texts[7])]
        df = spark.createDataFrame([(i, t, 0, "") for i, t in docs], "doc_id long, text string, lot int, part string").repartition(5)
        assert rows_of(remove_repeats(df, block=block)) == plain(docs)


def test_spans_ids_and_empty_table(spark):
    a = "".join(random.Random(4).choices("abcdefgh", k=260))
    df = spark.createDataFrame([(7, a), (7, a), (9, "--" + a[:150] + "--" + a[100:] + "-")], "doc_id long, text string")
    rows = remove_repeats(df).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 260, 310]
    last = next(r for r in rows if r["doc_id"] == 9)
    assert [tuple(s) for s in last["spans"]] == [(2, 152), (154, 314)] and last["kept"] == b"-----"
    assert remove_repeats(df.limit(0)).count() == 0
