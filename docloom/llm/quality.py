"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk over trusted positives and unlabelled web text.

With class prior p, losses l(z, +1) = softplus(-z) and l(z, -1) = softplus(z): minimise
p * mean_pos l(z, +1) + max(0, mean_unl l(z, -1) - p * mean_pos l(z, -1)), by steps along its gradient, which is that of the
first part alone where the second is below zero. The prior is estimated without negative labels: on positives and unlabelled
texts that a classifier has not seen, it can't exceed the unlabelled share above any score divided by the positives' share
there, and reaches it where some positives score above all negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import hash_share, table
from docloom.llm.textblock import Block, spans, strings

FOLDS, HELD_OUT, ACCEPT = 5, 0, 0.3
#: About so many positives and so many unlabelled documents are fitted on, chosen by a hash of the id; of these, so many of each
#: at most for the prior.
SAMPLE, PRIOR_SAMPLE = 12_000, 5000
FEATURES = ["log_words", "log_bytes", "word_length", "upper", "digits", "stops", "marks", "symbols", "pipes", "exclaims", "word_ends_in_symbol", "word_is_symbols", "repeats_last_word", "distinct_words", "breaks", "wide_bytes", "longest_word"]
#: Bytes of text whose features are made at once: they take about 100 times as much memory while they are made.
FEATURE_BYTES = 128 << 10
#: Buckets of hashed words, and of hashed runs of four bytes: their shares in a text are features too.
BUCKETS, RUN = 64, 4
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "?'\"()-", "#$%&*+/<=>@[\\]^_`{}~", "|", "!", "\n"], 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 9


def shares(bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How often each bucket occurs in each of n texts, against an even spread: 0 is even, -1 never, at most 4."""
    count = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    total = count.sum(1, keepdims=True)
    return np.minimum(np.where(total > 0, count * (BUCKETS / np.maximum(total, 1)) - 1, 0), 4)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES, then bucket shares of words and of runs of bytes, for each text, from the whole text; zeros for an empty one."""
    data, offsets = strings(texts)
    out = np.zeros((len(texts), len(FEATURES) + 2 * BUCKETS), np.float32)
    for lo, hi in spans(offsets, FEATURE_BYTES):
        b = Block(data, offsets, lo, hi, lower=False)
        size = np.diff(b.text_at).astype(float)
        doc = np.repeat(np.arange(b.n), np.diff(b.text_at))
        kinds = _CLASS[b.raw]
        count = np.bincount(doc * 10 + kinds, minlength=b.n * 10).reshape(b.n, 10)[:, 1:].astype(float)
        words = np.diff(b.first).astype(float)
        hashes = b.word_hashes()
        of = np.repeat(np.arange(b.n), np.diff(b.first))
        length = b.end - b.start
        total = lambda x: np.bincount(of, x, b.n)
        n, w = np.maximum(size, 1), np.maximum(words, 1)
        tail = kinds[b.end - 1] if len(b.end) else np.zeros(0, int)
        odd = np.isin(tail, (5, 6, 7))
        symbol = np.concatenate([[0], np.cumsum(np.isin(kinds, (3, 4, 5, 6, 7)))])
        alone = symbol[b.end] - symbol[b.start] == length
        again = np.zeros(len(hashes))
        if len(hashes) > 1:
            again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        distinct = np.array([len(np.unique(hashes[x:y])) for x, y in zip(b.first[:-1], b.first[1:], strict=True)], float)
        longest = np.zeros(b.n)
        np.maximum.at(longest, of, length)
        block = [np.log1p(words), np.log1p(size), total(length) / w, *(count[:, i] / n for i in range(3)), count[:, 3] / n, count[:, 4] / n, count[:, 5] / n, count[:, 6] / n, total(odd) / w, total(alone) / w, total(again) / w, distinct / w, count[:, 7] / n, count[:, 8] / n, np.log1p(longest)]
        out[lo:hi, : len(FEATURES)] = np.stack(block, 1)
        out[lo:hi, len(FEATURES) : len(FEATURES) + BUCKETS] = shares((hashes >> np.uint64(58)).astype(np.int64), of, b.n)
        raw = b.raw.astype(np.uint32)
        if len(raw) >= RUN:
            run = sum(raw[i : len(raw) - RUN + 1 + i] << np.uint32(8 * i) for i in range(RUN)) * np.uint32(0x9E3779B1)
            inside = doc[: len(run)] == doc[RUN - 1 :]
            out[lo:hi, len(FEATURES) + BUCKETS :] = shares((run >> np.uint32(26)).astype(np.int64)[inside], doc[: len(run)][inside], b.n)
    return out


#: Shares of the fitted texts at which each feature is cut: an additive model of steps, which no odd value can upset.
SHARES = [0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.25, 0.5, 0.75, 0.85, 0.88, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99, 0.995]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Cuts of each feature and what a text gains by passing them, from `base` on, and the weights of bucket shares; `prior` is the class prior it was fitted with."""

    cuts: list[np.ndarray]
    gains: list[np.ndarray]
    linear: np.ndarray
    base: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.base + x[:, len(FEATURES) :].astype(float) @ self.linear
        for i, (c, g) in enumerate(zip(self.cuts, self.gains, strict=True)):
            z += np.concatenate([[0.0], np.cumsum(g)])[np.searchsorted(c, x[:, i], "left")]
        return sigmoid(z)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' part of the risk, the negatives' unbiased part, and the gradient of the first plus the non-negative part of the second."""
    zp, zu = p @ w.astype(np.float32), u @ w.astype(np.float32)
    good, bad = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    grad = prior * ((sigmoid(zp) - 1) @ p) / len(p)
    if bad > 0:
        grad = grad + sigmoid(zu) @ u / len(u) - prior * (sigmoid(zp) @ p) / len(p)
    return good, bad, grad


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 3e-4) -> Model:
    """Full-batch Adam on the non-negative risk, averaged over its last half, with the level at which unlabelled texts score the prior in the mean.

    Without positives or unlabelled texts every text scores the prior.
    """
    odds = np.clip(prior, 1e-3, 1 - 1e-3)
    base = float(np.log(odds / (1 - odds)))
    kinds, buckets = len(FEATURES), 2 * BUCKETS
    if not len(positive) or not len(unlabelled):
        return Model([np.zeros(0)] * kinds, [np.zeros(0)] * kinds, np.zeros(buckets), base, prior)
    both = np.concatenate([positive[:, :kinds], unlabelled[:, :kinds]])
    cuts = [np.unique(np.quantile(both[:, i], SHARES)).astype(np.float32) for i in range(kinds)]
    passed = lambda x: np.concatenate([np.ones((len(x), 1), np.float32), *((x[:, i : i + 1] > c[None, :]).astype(np.float32) for i, c in enumerate(cuts)), x[:, kinds:]], 1, dtype=np.float32)
    p, u = passed(positive), passed(unlabelled)
    w, mean = np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[0] = base
    at = np.cumsum([1, *map(len, cuts)])
    # bucket shares are many and noisy: they decay faster and learn slower than steps
    ease, pace = np.full(len(w), decay), np.full(len(w), rate)
    ease[at[-1] :], pace[at[-1] :] = 10 * decay, rate / 20
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        grad = risk(w, p, u, prior)[2] + ease * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= pace * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > steps:
            mean += w / (steps // 2 + steps % 2)
    z, lo, hi = u @ mean.astype(np.float32), -60.0, 60.0
    for _ in range(60):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if sigmoid(z + middle).mean() < odds else (lo, middle)
    return Model(cuts, [mean[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], mean[at[-1] :], float(mean[0] + lo), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, parts: int = 5, rounds: int = 2) -> float:
    """The class prior of unlabelled texts, from positives and unlabelled ones alone; one half where there are fewer than 20 of either.

    Each part of both is scored by a classifier fitted on the other parts, in the first round with a prior of one half, then
    with the one found; the least ratio of the unlabelled to the positives' share above a score, over scores that half of
    the positives reach, is the estimate.
    """
    prior = 0.5
    if min(len(positive), len(unlabelled)) < 20:
        return prior
    for _ in range(rounds):
        scores: tuple[list, list] = ([], [])
        for k in range(parts):
            own = [np.arange(len(x)) % parts == k for x in (positive, unlabelled)]
            model = fit(positive[~own[0]], unlabelled[~own[1]], prior, steps=200)
            for out, x, o in zip(scores, (positive, unlabelled), own, strict=True):
                out.append(model.score(x[o]))
        a, b = (np.sort(np.concatenate(x)) for x in scores)
        cut = np.concatenate([a, b])
        good, every = (1 - np.searchsorted(x, cut, "left") / len(x) for x in (a, b))
        prior = float(np.clip((every[good >= 0.5] / good[good >= 0.5]).min(), 0.01, 0.99))
    return prior


def fold(id_col: str | Column) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, prior: float | None = None) -> Model:
    """A model from labels of training folds only: positives are rows of quality 1, unlabelled are documents of training folds, whatever their label.

    The prior, unless given, is `estimated_prior`; no negative label is read. Ids, languages and sources are not read by
    the model. Of each kind about `sample` ids, by a hash, are fitted on, one document of each (of several of one id the
    least text); null ids and labels without a document are left out; without positives every text scores one half.
    """
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != HELD_OUT))
    positives = known.count()
    total = docs.count()
    key = docs[id_col]
    texts = docs.where(key.isNotNull() & (fold(id_col) != HELD_OUT)).select(key.alias("id"), F.col(text_col).cast("string").alias("text"))
    trusted = known.where(hash_share(F.col("doc_id"), 11) < min(1.0, sample / max(1, positives))).select(F.col("doc_id").alias("_id")).distinct()
    # the sample of ids is bounded, so it is sent to where the texts are
    one = lambda rows, kind: rows.groupBy("id").agg(F.min("text").alias("text")).select("text", F.lit(kind).alias("kind"))
    positive = one(texts.join(F.broadcast(trusted), F.col("id") == F.col("_id"), "left_semi"), 1)
    web = one(texts.where(hash_share(F.col("id"), 12) < min(1.0, sample / max(1, total))), 0)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows, batch.column(1)], ["x", "kind"])

    rows = positive.unionByName(web).mapInArrow(convert, "x array<float>, kind int").toArrow()
    wide = len(FEATURES) + 2 * BUCKETS
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, wide) if rows.num_rows else np.zeros((0, wide), np.float32)
    kind = rows.column("kind").to_numpy() if rows.num_rows else np.zeros(0, int)
    # sums and halves don't depend on how rows arrived
    order = np.lexsort(np.concatenate([x[:, : len(FEATURES) + 8].T, kind[None, :]])) if len(x) else np.zeros(0, int)
    del rows
    order = order[np.random.default_rng(5).permutation(len(x))]
    good, web = (x[order[kind[order] == k]] for k in (1, 0))
    del x
    return fit(good, web, estimated_prior(good[:PRIOR_SAMPLE], web[:PRIOR_SAMPLE]) if prior is None else prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with `out_col`: how likely the whole text is of quality 1. Null texts are empty; a column of that name is replaced."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(features(texts)))

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs that the classifier trained on them accepts; columns, whatever their names, and repeated rows stay.

    Null texts are scored as empty ones; equal texts have equal scores, and a score of just ACCEPT is kept; rows with a
    null id are scored like any other; an empty table gives an empty table; without positives everything is kept.
    """
    rows = score(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text")), train(docs, labels, text_col=text_col))
    return rows.where(F.col("score") >= ACCEPT).select("doc.*")
