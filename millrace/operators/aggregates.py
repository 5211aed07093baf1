"""Grouped folds. Those that depend on order take a total order: time, then a tie-breaking id."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999)


def reduce(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """A reducer of one's own over all rows of a key, which must fit a task's memory."""
    return df.groupBy(key).applyInArrow(fn, schema)


def merge_partials(partials: list[DataFrame], key: str, sums: list[str] = (), mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """Partial results of several calls folded into one."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs])


def key_index(df: DataFrame, key: str, row: str) -> DataFrame:
    """key, rows: the sorted row numbers of each key."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def counter_fold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sum, min, max, count and the whole average of counters."""
    out = df.groupBy(*keys).agg(F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))
    return out.withColumn("avg", F.expr("sum div count"))


def steady_sum(df: DataFrame, value: str) -> Column:
    """Sum that does not depend on the order of rows. Doubles are added as decimals, exactly; what those leave of a value
    (below its tenth decimal, or all from 1e18 on, infinity and NaN) is added as doubles."""
    if df.schema[value].dataType.typeName() not in ("double", "float"):
        return F.sum(value)
    whole = F.col(value).try_cast("decimal(28,10)")
    rest = F.coalesce(F.col(value) - whole.cast("double"), F.col(value))
    return F.coalesce(F.sum(whole).cast("double"), F.lit(0.0)) + F.sum(rest)


def double_fold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As counter_fold for doubles; the average is cut to a whole number."""
    out = df.groupBy(*keys).agg(steady_sum(df, value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))
    return out.withColumn("avg", (F.col("sum") / F.col("count")).cast("long"))


def gauge_fold(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """As double_fold, with the last value by order that is not null."""
    out = df.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("last"), steady_sum(df, value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))
    return out.withColumn("avg", (F.col("sum") / F.col("count")).cast("long"))


def histogram_fold(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """sum, min, max, count, avg and exact quantiles (p50 ... p9999)."""
    name = lambda q: "p" + str(q)[2:].ljust(2, "0")
    out = df.groupBy(*keys).agg(F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"), *[F.percentile(value, F.lit(q)).alias(name(q)) for q in quantiles])
    return out.withColumn("avg", F.col("sum") / F.col("count"))


def sketch_fold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sum, min, max, count and a mergeable quantile sketch."""
    return df.groupBy(*keys).agg(F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"), F.expr(f"kll_sketch_agg_double({value})").alias("sketch"))


def sketch_merge(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key by order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def array_stats(df: DataFrame, key: str, values: str) -> DataFrame:
    return df.agg(F.count(key).alias("n"), F.avg(F.size(values)).alias("avg_size"))


def column_units(df: DataFrame) -> DataFrame:
    """column, units: the longest value (strings), size (collections) or 1, over all rows, in one pass."""
    widths = []
    for name, kind in df.dtypes:
        width = F.length(name) if kind == "string" else F.size(name) if kind.startswith(("array", "map")) else F.lit(1)
        widths.append(F.struct(F.lit(name).alias("column"), F.coalesce(F.max(width), F.lit(0)).cast("long").alias("units")))
    return df.agg(F.array(*widths).alias("w")).select(F.inline("w"))


def bench_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """min and average time, best and average rate; rows that do not parse (stray headers) are left out."""
    rows = df.select(*keys, F.expr("try_cast(time_s as double)").alias("t"), F.expr("try_cast(rows_per_sec as double)").alias("r")).where("t is not null and r is not null")
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.min("t").alias("min_time"), F.avg("t").alias("avg_time"), F.max("r").alias("max_rate"), F.avg("r").alias("avg_rate"))


def random_k(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows without replacement, by a hash order of their keys: the same rows for the same seed."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(k)


def k_means(df: DataFrame, k: int, columns: list[str], max_iter: int = 20, seed: int = 0):
    """Fitted model and rows with `cluster`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="_features").transform(df)
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_features", predictionCol="cluster").fit(ready)
    return model, model.transform(ready).drop("_features")
