"""Tails and quantiles of the distributions that the tests need, as Arrow functions over columns: no SciPy is asked for."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-15:
            break
    return front * out


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return 1.0 if t == 0 else beta_share(df / (df + t * t), df / 2, 0.5) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """The value below which the share p of Student's t lies, by bisection."""
    if p == 0.5:
        return 0.0
    lo, hi = 0.0, 1.0
    tail = 2 * min(p, 1 - p)
    while t_tail(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > tail else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def sign_test(k: int, n: int) -> float:
    """Two-sided exact binomial test of k in n at one half, which is McNemar's exact test on discordant pairs."""
    if n == 0:
        return 1.0
    if 2 * k == n:
        return 1.0
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
    return min(1.0, 2 * beta_share(0.5, n - min(k, n - k), min(k, n - k) + 1))  # the binomial tail as a beta share


def signed_rank(n: int, low: float, ties: float, exact: bool) -> float:
    """Two-sided p of Wilcoxon's signed-rank test from the number of differences that are not zero, the lesser rank sum and the sum of t^3 - t over ties: exact up to 50 if asked, else normal with tie correction."""
    n = int(n)
    if exact and n <= 50:
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(low - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def _each(function, columns):
    args = zip(*(c.to_pylist() for c in columns), strict=True)
    return pa.array([None if any(a is None or a != a for a in row) else function(*row) for row in args], pa.float64())


@F.arrow_udf(T.DoubleType())
def t_p_value(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(t, degrees of freedom) -> two-sided p."""
    for t, df in batches:
        yield _each(t_tail, (t, df))


@F.arrow_udf(T.DoubleType())
def t_critical(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(share, degrees of freedom) -> quantile."""
    for p, df in batches:
        yield _each(t_quantile, (p, df))


@F.arrow_udf(T.DoubleType())
def mcnemar_p(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(only a, only b) -> exact two-sided p."""
    for a, b in batches:
        yield _each(lambda x, y: sign_test(x, x + y), (a, b))


@F.arrow_udf(T.DoubleType())
def wilcoxon_p(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(differences that are not zero, lesser rank sum, tie sum, whether exact) -> two-sided p; null where all are zero."""
    for columns in batches:
        yield _each(signed_rank, columns)
