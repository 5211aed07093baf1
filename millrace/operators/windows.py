"""Trailing windows over arrays and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _trailing_sum(values: Column, i: Column, w: int) -> Column:
    return F.aggregate(F.slice(values, F.greatest(F.lit(1), i - w + 2), F.least(i + 1, F.lit(w))), F.lit(0.0), lambda acc, x: acc + x)


def moving_average(values: Column, w: int) -> Column:
    """Mean of each element and the w - 1 before it, fewer at the head."""
    return F.transform(values.cast("array<double>"), lambda _, i: _trailing_sum(values.cast("array<double>"), i, w) / F.least(i + 1, F.lit(w)))


def moving_sum(values: Column, w: int) -> Column:
    return F.transform(values.cast("array<double>"), lambda _, i: _trailing_sum(values.cast("array<double>"), i, w))


def moving_count(values: Column, w: int) -> Column:
    return F.transform(values, lambda _, i: F.least(i + 1, F.lit(w)).cast("long"))


def trailing_rows(df: DataFrame, keys: list[str], order: list[str], value: str, w: int) -> DataFrame:
    """Adds moving_avg, moving_sum, moving_count over the row and the w - 1 before it, within keys.

    Without keys all rows form one sequence, which one task must process; only for small inputs.
    """
    frame = (Window.partitionBy(*keys) if keys else Window).orderBy(*order).rowsBetween(1 - w, 0)
    return df.withColumns({f"moving_{n}": f(value).over(frame) for n, f in (("avg", F.avg), ("sum", F.sum), ("count", F.count))})


def exploded(df: DataFrame, key: str, values: str) -> DataFrame:
    return df.select(key, F.posexplode(values).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def collect_windows(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows back into arrays, in the order of pos."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(value))


def largest_difference(df: DataFrame, key: str, values: str, w: int) -> DataFrame:
    """One row, max_diff: moving_average against a recomputation by rows."""
    by_rows = collect_windows(trailing_rows(exploded(df, key, values), [key], ["pos"], "value", w), key, "moving_avg")
    both = df.select(key, moving_average(F.col(values), w).alias("own")).join(by_rows, key)
    return both.agg(F.max(F.array_max(F.zip_with("own", "moving_avg", lambda a, b: F.abs(a - b)))).alias("max_diff"))


def recent(df: DataFrame, time: str, now: Column, ttl_ms: int) -> DataFrame:
    """Rows not older than ttl_ms before now (epoch milliseconds)."""
    return df.where(F.col(time) >= now - ttl_ms)


def key_window(df: DataFrame, key: str, time: str, now: Column, ttl_ms: int, *value: str) -> DataFrame:
    """key, rows: the recent rows of each key, newest first. A key's recent rows must fit a row."""
    rows = F.sort_array(F.collect_list(F.struct(time, *value)), asc=False)
    return recent(df, time, now, ttl_ms).groupBy(key).agg(rows.alias("rows"))
