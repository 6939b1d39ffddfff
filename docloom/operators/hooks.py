"""Provider hooks: a function from a list of inputs to a list of outputs (a model, a judge, an extractor), run by partition."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Provider = Callable[[list[str]], list[str | None]]


class Overloaded(Exception):
    """The provider asks to come again later."""


class Exhausted(Exception):
    """The provider will not answer any more; the job ends."""


def with_retries(provider: Provider, tries: int = 3, first: float = 5.0, most: float = 60.0, sleep=time.sleep) -> Provider:
    """Overload waits twice as long each time; exhaustion ends the job; any other error leaves its rows null after the last try."""

    def call(rows: list[str]) -> list[str | None]:
        for n in range(tries):
            try:
                out = provider(rows)
                return list(out) if len(out) == len(rows) else [None] * len(rows)  # an answer of another length is no answer
            except Exhausted:
                raise
            except Overloaded:
                sleep(min(most, first * 2**n))
            except Exception:  # noqa: BLE001
                continue
        return [None] * len(rows)

    return call


def ask(df: DataFrame, column: str, out: str, provider: Provider, batch: int = 8, partitions: int | None = None) -> DataFrame:
    """df with `out`, the provider's answers to `column`, so many rows to a call; `partitions` bounds how many calls run at once."""

    @F.arrow_udf(T.StringType())
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for xs in batches:
            rows = [x or "" for x in xs.to_pylist()]
            yield pa.array([a for i in range(0, len(rows), batch) for a in provider(rows[i : i + batch])], pa.string())

    rows = df.repartition(partitions) if partitions else df
    return rows.withColumn(out, answers.asNondeterministic()(F.col(column)) if hasattr(answers, "asNondeterministic") else answers(F.col(column)))


def ask_once(df: DataFrame, column: str, out: str, provider: Provider, known: DataFrame | None = None, key: list[str] | None = None, **how) -> DataFrame:
    """As `ask`, but each different value is asked once, and those of `known` (column, out) not at all.

    With a `key`, such as digest and kind of an attachment, one row of each key is asked, and `known` is (key, out).
    """
    key = key or [column]
    values = df.select(column).distinct() if key == [column] else df.groupBy(*key).agg(F.min(column).alias(column))
    if known is not None:
        values = values.join(known.select(*key), key, "left_anti")
    answered = ask(values, column, out, provider, **how).select(*key, out)
    if known is not None:
        answered = answered.unionByName(known.select(*key, out))
    return df.join(answered, key, "left")


def scored(df: DataFrame, answer: str, out: str, low: int = 1, high: int = 5) -> DataFrame:
    """A judge's answer as a whole number in its range, else null."""
    x = F.col(answer).try_cast("int")
    return df.withColumn(out, F.when(x.between(low, high), x))
