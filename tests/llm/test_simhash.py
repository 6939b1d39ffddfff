import random
import re

import numpy as np
import pandas as pd
import xxhash

from docloom.llm import simhash as S


def brute_fp(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, fps):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return [least[root(i)] for i in range(len(rows))]


def test_against_brute_force_with_nulls_ties_and_clashing_columns(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ü", "AB"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 300))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split(" ")
        w[rng.randrange(len(w))] = "zz"
        rows.append((100 + i, rng.choice([" ", "\n", "  ", "\t "]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (5, base[5]), (5, base[5]), (None, base[3]), (None, "lonely text here now"), (203, "x" * 300_000)]
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(map(tuple, S.near_duplicates(df).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, brute_components(rows, fps), strict=True)), key=str)
    assert got == want


def test_links_join_what_hamming_distance_joins_even_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(150):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame(pd.DataFrame({"node": fps.view(np.int64), "lane": 0, "fp": fps.view(np.int64)}))
    got = {r.node: r.root for r in S.components(S.links(df)).collect()}
    rows = [(int(x), None) for x in fps.view(np.int64)]
    want = brute_components(rows, fps.tolist())
    assert {r: got.get(r, r) for r, _ in rows} == {r: w for (r, _), w in zip(rows, want, strict=True)}


def grams(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(30):
        w = rng.choices(vocab, k=rng.randint(40, 400))
        rows.append((i, " ".join(w)))
        for _ in range(rng.choice([0, 1, 3])):
            v = list(w)
            for _ in range(rng.choice([0, 1, len(w) // 60, len(w) // 12])):
                v[rng.randrange(len(v))] = "changed" + str(rng.random())
            rows.append((100 + len(rows), " ".join(v)))
    rows += [(900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (3, "another text under a used id"), (None, rows[0][1]), (None, None), (903, "Short Text"), (904, "short\ttext"), (905, "x" * 100_000)]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                a, b = grams(rows[i][1]), grams(rows[j][1])
                if rows[i][0] is not None and rows[j][0] is not None and (not a | b or len(a & b) >= 0.8 * len(a | b)):
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for (d, _), g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append(d)
    want = sorted(min(x) for x in groups.values() if x[0] is not None)
    df = spark.createDataFrame([(d, t, "en", 5) for d, t in rows], "doc_id long, text string, lang string, node int")
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(x for x in ids if x is not None) == want
    assert ids.count(None) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).collect() == []
    assert S.drop_near_duplicates(df).collect() == []


def test_every_close_pair_has_a_chain_and_a_shared_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = np.uint64(0)
        for b in rng.choice(64, 3, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        assert any(S.chained(S.rotated(np.array([x]), np.array([s])))[0] for s in range(8))


def test_near_duplicates_of_the_stage_hold_the_links_of_fingerprints(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(900)]
    notice = rng.sample(vocab, 7)
    rows = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(12)]
    # a notice again and again decides the fingerprint; what follows it is another set of shingles
    rows += [(100 + i, " ".join(notice * 40 + rng.choices(vocab, k=25))) for i in range(8)]
    fps = [S.simhash_one(t.encode(), 3) for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= S.MOST]
    apart = [(i, j) for i, j in close if len(grams(rows[i][1]) & grams(rows[j][1])) < 0.8 * len(grams(rows[i][1]) | grams(rows[j][1]))]
    assert apart
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in S.drop_near_duplicates(df).collect()}
    assert kept == {r.component_id for r in S.near_duplicates(df).collect()}
    assert not any({rows[i][0], rows[j][0]} <= kept for i, j in close)
