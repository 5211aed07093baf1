"""Co-grouping of two inputs by a key, and joins derived from it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_inputs(left: DataFrame, right: DataFrame | None, key: str | None) -> tuple[DataFrame, DataFrame, str]:
    """right defaults to left, the key to the first column; a missing key is an error."""
    right, key = left if right is None else right, key or left.columns[0]
    for side in (left, right):
        if key not in side.columns:
            raise ValueError(f"no column {key}")
    return left, right, key


def co_partition(left: DataFrame, right: DataFrame, key: str, world: int) -> tuple[DataFrame, DataFrame]:
    """Both sides partitioned alike: rows with equal keys have equal partition numbers. Nothing is matched or lost."""
    return left.repartition(world, key), right.repartition(world, key)


def cogroup(left: DataFrame, right: DataFrame, key: str, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn gets both sides' rows of a key as Arrow tables, also for keys of one side only. Both must fit a task's memory."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(fn, schema)


def counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right for every key of either side; null is a key. Only counts are joined."""
    a = left.groupBy(F.col(key).alias("a")).agg(F.count("*").alias("n_left"))
    b = right.groupBy(F.col(key).alias("b")).agg(F.count("*").alias("n_right"))
    joined = a.join(b, F.col("a").eqNullSafe(F.col("b")), "full")
    return joined.select(F.coalesce("a", "b").alias(key), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def nested(left: DataFrame, right: DataFrame, key: str, left_value: Column, right_value: Column) -> DataFrame:
    """key, left_rows, right_rows: sorted arrays of each side's values. A key's rows must fit a row; see join for more."""
    a = left.groupBy(F.col(key).alias("a")).agg(F.array_sort(F.collect_list(left_value)).alias("left_rows"))
    b = right.groupBy(F.col(key).alias("b")).agg(F.array_sort(F.collect_list(right_value)).alias("right_rows"))
    joined = a.join(b, F.col("a").eqNullSafe(F.col("b")), "full")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(joined.dtypes)[c]))
    return joined.select(F.coalesce("a", "b").alias(key), empty("left_rows").alias("left_rows"), empty("right_rows").alias("right_rows"))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    """Derived: inner, left, full, semi or anti join by an equal key, which never gathers a key's rows."""
    return left.join(right, F.col(left_key) == F.col(right_key), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
