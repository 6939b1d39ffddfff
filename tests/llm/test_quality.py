import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import quality as Q
from docloom.llm.textblock import Block

SF = "/root/testdata/sf0.01"


def test_held_out_labels_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.op5_quality(spark, SF).join(labels, "doc_id").collect()
    assert docs.count() == Q.op5_quality(spark, SF).count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, r.quality, r.predicted) for r in rows if r.held_out]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([p for _, q, p in held if q == 1]) > 0.97


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(Q.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, turned)
    assert a.base == b.base and all((x == y).all() for x, y in zip(a.gains, b.gains, strict=True))


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "a text", "s"), (3, "x" * 200_000, "s"), (3, "x" * 200_000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.train(docs, none)
    got = Q.score(docs, model).collect()
    assert len(got) == 5 and all(abs(r.score - 0.5) < 1e-9 for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(Q.score(docs, Q.train(docs, labels)).collect()) == 5
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels)).collect() == []
    more = docs.withColumns({"_score": F.lit("mine"), "text_": F.lit(1)})
    kept = Q.keep_good(more, none)
    assert kept.columns == more.columns and kept.count() == 5 and {r["_score"] for r in kept.collect()} == {"mine"}


def test_features_do_not_depend_on_the_block(spark):
    texts = ["Some words here, some WORDS there.", "", None, "a a a a ### b!! |", "\n\n", "é" * 50]
    whole = Q.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], Q.features(pa.array([t], pa.string()))[0])
    assert whole.shape[1] == len(Q.FEATURES) + 2 * Q.BUCKETS
    assert (whole[1] == 0).all() and (whole[2] == 0).all()


def sample_of(rng, n, at):
    x = rng.normal(at, 0.3, (n, len(Q.FEATURES) + 2 * Q.BUCKETS)).astype(np.float32)
    x[:, len(Q.FEATURES) :] = 0
    return x


def test_risk_is_non_negative_learning():
    rng = np.random.default_rng(0)
    good = sample_of(rng, 500, 1)
    mixed = np.concatenate([sample_of(rng, 400, 1), sample_of(rng, 100, -1)])
    m = Q.fit(good, mixed, 0.8)
    s = m.score(mixed)
    assert s[:400].min() > 0.3 > s[400:].max()


def test_risk_and_its_direction_by_brute_force():
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(0.5, 1, (40, 6)), rng.normal(0, 1, (50, 6)), rng.normal(0, 0.5, 6)
    loss = lambda z, y: math.log1p(math.exp(-y * z))

    def parts(w, prior):
        zp, zu = [float(x @ w) for x in p], [float(x @ w) for x in u]
        good = prior * sum(loss(z, 1) for z in zp) / len(zp)
        return good, sum(loss(z, -1) for z in zu) / len(zu) - prior * sum(loss(z, -1) for z in zp) / len(zp)

    below = 0
    for prior in (0.3, 0.9):
        for push in (0.0, 3.0):
            at = w.copy()
            at[0] -= push * (1 if p[:, 0].mean() > 0 else -1)
            good, bad, way = Q.risk(at, p.astype(np.float32), u.astype(np.float32), prior)
            want = parts(at, prior)
            assert np.allclose([good, bad], want, atol=1e-5)
            below += bad < 0
            for i in range(6):
                step = np.zeros(6)
                step[i] = 1e-5
                slope = lambda k: (parts(at + step, prior)[k] - parts(at - step, prior)[k]) / 2e-5  # noqa: E731, B023
                assert abs(way[i] - (slope(0) + max(0, bad > 0) * slope(1))) < 1e-3
    assert 0 < below < 4


def test_scores_by_brute_force():
    rng = np.random.default_rng(2)
    texts = pa.array(["Some words here, some WORDS there.", "", "a b " * 40, "### !! | x", "été " * 9] * 30)
    x = Q.features(texts)
    m = Q.fit(x[:90], x[60:], 0.6, steps=40)
    for row, s in zip(x[:5], m.score(x[:5]), strict=True):
        z = m.base + sum(g for i, (c, gs) in enumerate(zip(m.cuts, m.gains, strict=True)) for cut, g in zip(c, gs, strict=True) if row[i] > cut)
        z += sum(float(a) * float(b) for a, b in zip(row[len(Q.FEATURES) :], m.linear, strict=True))
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-6
    word = [int(h >> np.uint64(58)) for h in Block(np.frombuffer(b"a b", np.uint8), np.array([0, 3]), 0, 1, lower=False).word_hashes()]
    share = x[2][len(Q.FEATURES) : len(Q.FEATURES) + Q.BUCKETS]
    assert all(abs(share[k] - min(4, word.count(k) / 2 * Q.BUCKETS - 1)) < 1e-5 for k in range(Q.BUCKETS)) and rng is not None


def test_prior_is_estimated_without_negative_labels(spark):
    rng = np.random.default_rng(3)
    for share in (0.25, 0.5, 0.8):
        n = int(4000 * share)
        mixed = np.concatenate([sample_of(rng, n, 1), sample_of(rng, 4000 - n, -0.5)])[rng.permutation(4000)]
        assert abs(Q.estimated_prior(sample_of(rng, 3000, 1), mixed) - share) < 0.08
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    true = labels.agg(F.avg("quality")).first()[0]
    assert abs(Q.train(docs, labels).prior - true) < 0.1
    turned = Q.train(docs, labels.where("quality = 1"))  # negative labels are not read
    assert turned.prior == Q.train(docs, labels).prior


def test_features_take_memory_by_small_blocks():
    import tracemalloc

    texts = pa.array(["some words, and 12 more of them | here! " * 50] * 2000)
    tracemalloc.start()
    Q.features(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
