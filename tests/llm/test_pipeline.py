"""The pipeline as a whole, and each stage against what it must keep."""

import random

import pytest
import test_mixing
import test_pii
import test_simhash
from pyspark.sql import functions as F

import corpus_pipeline as C
from docloom.llm import quality
from docloom.llm.sentencepiece import decode

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run_is_its_stages_one_after_another(spark, docs):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    kept = docs
    for _, stage in C.STAGES[:-1]:
        rows = stage(spark, kept, SF).collect()
        kept = spark.createDataFrame(rows, docs.schema)
        assert kept.columns == docs.columns
    want = sorted((r.doc_id, tuple(r.ids)) for r in C.tokens_stage(spark, kept, SF).collect())
    got = C.run(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in decode(got).collect())


def test_stages_by_brute_force(spark, docs):
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: model.score(quality.features(__import__("pyarrow").array([r.text])))[0] for r in docs.collect()}
    good = C.quality_stage(spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= 0.3}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [test_simhash.grams(t) for _, t in rows]
    label = {d: d for d, _ in rows}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    single = C.near_duplicate_stage(spark, docs, SF)
    assert {r.doc_id for r in single.collect()} == {d for d, _ in rows if root(d) == d}
    clean = C.pii_stage(spark, docs, SF)
    before = dict(rows)
    for r in clean.collect():
        found = test_pii.base(before[r.doc_id])
        assert (r.text == before[r.doc_id]) or found
        assert not found or all(before[r.doc_id][a:b] not in r.text for k, a, b in found if k == "email")
        assert r.n_chars == len(r.text)
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    mixed = C.mixing_stage(spark, docs, SF).groupBy("source").agg(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))).alias("n")).collect()
    want = test_mixing.water(sizes)
    longest = max(len(t.split()) for _, t in rows)
    assert all(abs(r.n - want[r.source]) <= longest for r in mixed)


def test_odd_and_empty_tables(spark, docs):
    rng = random.Random(1)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "x" * 100_000, "en", None, 100_000)] + [(i, " ".join(rng.choices(["one", "two", "tree"], k=9)), "en", "s", 40) for i in (4, 5, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
