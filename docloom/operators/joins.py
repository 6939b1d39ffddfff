"""Joins with the checks that the evaluation and log operators rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A many-to-one left join: fails on a key that the right side has twice, or that it lacks."""
    counted = right.withColumn("_n", F.count("*").over(Window.partitionBy(*on)))
    joined = left.join(counted.withColumn("_hit", F.lit(True)), on, "left")
    bad = F.when(F.col("_hit").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no match for"), *(F.col(c).cast("string") for c in on)))).when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("several matches for"), *(F.col(c).cast("string") for c in on))))
    return joined.where(F.coalesce(bad.cast("boolean"), F.lit(True))).drop("_n", "_hit")


def with_default(left: DataFrame, right: DataFrame, on: list[str], column: str, default) -> DataFrame:
    """A left lookup of one column, with a default where the right side has no row."""
    return left.join(right.select(*on, column), on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def renamed(c: Column, names: dict[str, str]) -> Column:
    """Aliases mapped, other values as they are."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def overlay(base: DataFrame, other: DataFrame, on: list[str], columns: list[str], keep: list[str]) -> DataFrame:
    """base with `columns` of other where these are filled; of `keep`, base's own value goes first."""
    picked = other.select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(picked, on, "left")
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    for c in columns:
        order = [filled(c), filled(f"_{c}")] if c in keep else [filled(f"_{c}"), filled(c)]
        joined = joined.withColumn(c, F.coalesce(*order))
    return joined.select(*base.columns)


def complete_arms(df: DataFrame, unit: str, arm: str, value: str, arms: list[str]) -> DataFrame:
    """A row for each unit with a finite value in every arm: one pivot in place of as many joins."""
    finite = df.where(F.abs(F.col(value).cast("double")) < float("inf"))
    return finite.groupBy(unit).pivot(arm, arms).agg(F.first(value)).dropna(subset=arms)
