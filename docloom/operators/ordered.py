"""Row numbers, running sums and previous values over keys of any size: windows hold a range of a key's order, never a whole hot key.

A table that may be large is written once, dealt into ranges of the whole order (all its columns, of any types that can be
ordered, nulls first) by Spark's range partitioner, and written with the number of its range. Each range is summed up, and
the few range rows of a key get the window over the whole key. What the planner knows to be small gets plain windows.
Columns of the table may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.shared import unused, written

#: Rows of a range (about), ranges at most, and bytes up to which the planner's estimate makes a table one range.
ROWS_EACH, MOST, SMALL = 1_000_000, 65_535, 64 << 20


def in_ranges(df: DataFrame, order: list[str], mark: str, rows_each: int | None = None) -> DataFrame | None:
    """df with the range of each row as `mark`, rising with the order; None where one range holds all and df is small. `rows_each` is given in tests."""
    if rows_each is None and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL:
        return None
    rows = written(df, "ordered")
    parts = min(MOST, -(-rows.count() // (rows_each or ROWS_EACH)))
    if parts <= 1:
        return rows.withColumn(mark, F.lit(0))
    return written(rows.repartitionByRange(parts, *order).withColumn(mark, F.spark_partition_id()), "ranges")


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def running(df: DataFrame, keys: list[str], order: list[str], value: str | Column, out: str, rows_each: int | None = None, total: str | None = None) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the key that precede this one in the order; 0 for the first. With `total`, the sum over the whole key too."""
    value = F.col(value) if isinstance(value, str) else value
    own, mark, sums, before, inside = unused(df, "_value", "_range", "_sum", "_before", "_inside")
    valued = df.withColumn(own, value)
    rows = in_ranges(valued, order, mark, rows_each)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    if rows is None:
        w = Window.partitionBy(*keys)
        more = [] if total is None else [zero(F.sum(own).over(w)).alias(total)]
        return valued.select(*df.columns, zero(F.sum(own).over(ahead(w.orderBy(*order)))).alias(out), *more)
    each = rows.groupBy(*keys, mark).agg(F.sum(own).alias(sums))
    whole = Window.partitionBy(*keys)
    ranged = each.select(*keys, mark, zero(F.sum(sums).over(ahead(whole.orderBy(mark)))).alias(before), zero(F.sum(sums).over(whole)).alias(sums))
    inner = rows.withColumn(inside, zero(F.sum(own).over(ahead(Window.partitionBy(*keys, mark).orderBy(*order)))))
    joined = inner.join(ranged, same(inner, ranged, [*keys, mark]), "left")
    more = [] if total is None else [F.col(sums).alias(total)]
    return joined.select(*(inner[c] for c in df.columns), (F.col(before) + F.col(inside)).alias(out), *more)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, rows_each: int | None = None) -> DataFrame:
    """df with `out`: 1, 2, ... by key in the order, which is to be total."""
    (name,) = unused(df, "_number")
    rows = running(df, keys, order, F.lit(1), name, rows_each)
    return rows.select(*df.columns, (F.col(name) + 1).alias(out))


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows_each: int | None = None) -> DataFrame:
    """df with `out`: the value of the row before this one in its key, null for the first."""
    mark, end, last, at, own = unused(df, "_range", "_end", "_last", "_at", "_own")
    rows = in_ranges(df, order, mark, rows_each)
    if rows is None:
        return df.select("*", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)).alias(out))
    ends = rows.groupBy(*keys, mark).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias(end))
    ends = ends.select(*keys, mark, F.lag(end).over(Window.partitionBy(*keys).orderBy(mark))["v"].alias(last))
    inside = Window.partitionBy(*keys, mark).orderBy(*order)
    inner = rows.withColumn(at, F.row_number().over(inside)).withColumn(own, F.lag(value).over(inside))
    joined = inner.join(ends, same(inner, ends, [*keys, mark]), "left")
    return joined.select(*(inner[c] for c in df.columns), F.when(F.col(at) == 1, F.col(last)).otherwise(F.col(own)).alias(out))
