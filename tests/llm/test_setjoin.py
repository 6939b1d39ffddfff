import random

import pytest
from test_simhash import grams

from docloom.llm import simhash as S


def kept_by_brute_force(rows):
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
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def kept(spark, rows):
    return sorted(r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def edited(rng, words, n):
    """words with n of them replaced, far from each other."""
    out = list(words)
    for i in rng.sample(range(len(words) // 6), n):
        out[6 * i] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize(("rows_of_bucket", "bytes_of_bucket"), [(40, 16 << 20), (4096, 16 << 20), (4096, 100_000)])
def test_edited_copies_of_one_original_and_texts_of_one_bag(spark, monkeypatch, rows_of_bucket, bytes_of_bucket):
    from docloom.llm import setjoin

    for name in ("SET_ROWS", "_COLUMNS"):
        monkeypatch.setattr(setjoin, name, rows_of_bucket)
    monkeypatch.setattr(setjoin, "SET_BYTES", bytes_of_bucket)
    rng = random.Random(5)
    rows = []
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows.append((700, " ".join(words)))
    rows += [(1000 + i, edited(rng, words, 5)) for i in range(350)]
    # one bag of words: orders of sentences that are no near copies, and a near copy of each of them
    sentences = [" ".join(f"s{rng.randrange(400)}" for _ in range(6)) for _ in range(40)]
    for i in range(60):
        rng.shuffle(sentences)
        text = " ".join(sentences)
        rows += [(2000 + i, text), (3000 + i, text.rsplit(" ", 12)[0])]
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_products_and_forest_against_brute_force():
    import numpy as np

    from docloom.llm import setjoin

    rng = random.Random(9)
    base = set(range(100))
    sets = [sorted((base - set(rng.sample(range(100), k))) | {1000 + rng.randrange(10**6) for _ in range(k)}) for k in [0, 2, 4, 6, 9, 11, 14, 20] * 8] + [[], [5], [5]]
    flat, at = np.array([x for s in sets for x in s]), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    near = setjoin.alike(flat, at, 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or near[i, j] == (len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-6)
    root = np.arange(len(sets))
    root[[7, 15]] = 7  # joined by what came before
    edges = setjoin.forest(near, root)
    assert all(near[i, j] and root[i] != root[j] for i, j in edges)

    def parts(pairs):
        label = root.copy()
        for _ in label:
            for i, j in pairs:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
        return label.tolist()

    assert parts(edges) == parts(zip(*np.nonzero(near), strict=True)) and len(edges) < len(sets)


def test_appended_truncated_and_block_edited_copies(spark):
    rng = random.Random(6)
    draw = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(45):
        n = rng.choice([100, 300, 1000])
        words, share = draw(n), rng.uniform(0.06, 0.28)
        m = int(n * share)
        near = [words + draw(m), words[: n - m], words[: n // 3] + draw(m // 2) + words[n // 3 + m // 2 :]][i % 3]
        rows += [(i, " ".join(words)), (100 + i, " ".join(near))]
    want = kept_by_brute_force(rows)
    assert 45 < len(want) < 90
    assert kept(spark, rows) == want


def test_what_is_joined_goes_on_as_a_star(spark, monkeypatch):
    from docloom.llm import common, minhash, setjoin

    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows = []
    for i in range(40):  # a chain of copies, each an edit away from the one before
        words[rng.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(words)))
    tables = []
    monkeypatch.setattr(common, "written", lambda df, name, write=common.written: tables.append(name) or write(df, name))
    monkeypatch.setattr(setjoin, "components", lambda edges, find=common.components: tables.append("begin") or find(edges))
    base = S.F.sha1("text").alias("h")
    base = spark.createDataFrame(rows, "id long, text string").select("id", base, "text")
    classes = setjoin.numbered(common.written(minhash.banded(base), "sets"))
    chain = spark.createDataFrame([(i + 1, i) for i in range(30)], "at long, before long")
    ends = classes.select("node", S.F.col("k.id").alias("id"))
    known = chain.join(ends.toDF("a", "at"), "at").join(ends.toDF("b", "before"), "before").select(S.F.greatest("a", "b").alias("a"), S.F.least("a", "b").alias("b"))
    joined = setjoin.joined_nodes(base, classes, minhash.SHINGLE, 0.8, known).collect()
    assert len(joined) == 39 and len({r.root for r in joined}) == 1
    rounds = [x.split().count("edges") for x in " ".join(tables).split("begin")[1:]]
    assert len(rounds) == 3 and rounds[2] == 2, rounds  # nothing new to join: the stars, and a round that leaves them as they are
