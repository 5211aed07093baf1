"""Keyed exchange: where rows go, and proof that they went there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def key_hash(df: DataFrame, key: str) -> Column:
    """Integers stand for themselves; other keys are hashed."""
    return F.col(key).cast("long") if dict(df.dtypes)[key] in INTEGERS else F.xxhash64(key)


def placement(hashed: Column, world: int) -> Column:
    return F.pmod(F.coalesce(hashed, F.lit(0)), F.lit(world)).cast("int")


def placement_alternate(hashed: Column, world: int) -> Column:
    """Modulo world, or modulo world - 1 if world is even."""
    return placement(hashed, world - 1 if world % 2 == 0 and world > 1 else world)


def shuffle(df: DataFrame, key: str, world: int | None, partitioner: Callable[[Column, int], Column] | None = None, *, one_sided: bool = True) -> DataFrame:
    """Rows with equal keys meet in one partition, the one that the partitioner names.

    Without a partitioner or a world, Spark's own hash partitioning decides, which later joins and aggregations by the key
    use again. one_sided names a transport that Spark does not have to choose. world <= 1 leaves one partition.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    if world is not None and world <= 1:
        return df.coalesce(1)
    if partitioner is None:
        return df.repartition(world, key) if world else df.repartition(key)
    return df.repartitionById(world, partitioner(key_hash(df, key), world))


def rebalance(df: DataFrame, world: int) -> DataFrame:
    return df.repartition(world)


def misplaced(df: DataFrame, key: str, world: int, partitioner: Callable[[Column, int], Column] = placement) -> DataFrame:
    """Rows of a shuffled frame that are not where the partitioner sends them."""
    return df.where(F.spark_partition_id() != partitioner(key_hash(df, key), world))


def destinations(df: DataFrame, key: str, world: int) -> DataFrame:
    return df.withColumn("_hash", placement(key_hash(df, key), world))


def placement_sort(df: DataFrame, key: str, world: int, *order: str) -> DataFrame:
    """Adds dest and pos, the row's place among those with the same destination."""
    rows = df.withColumn("dest", placement(key_hash(df, key), world))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("dest").orderBy(key, *order)).cast("long") - 1)


def salted(df: DataFrame, key: str, by: Column, salts: int = 100) -> DataFrame:
    """Adds salted_key, `key:salt`, which splits a hot key over salts."""
    return df.withColumn("salted_key", F.concat(F.col(key).cast("string"), F.lit(":"), F.pmod(by, F.lit(salts)).cast("string")))


def key_histogram(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """key, spread: array of (rank, count) sorted by rank."""
    counts = df.groupBy(key, rank.cast("int").alias("rank")).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("spread"))


def totals(df: DataFrame, key: str) -> DataFrame:
    """One row: number of rows, sum and maximum of the key."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(key).alias("key_sum"), F.max(key).alias("key_max"))
