"""Deterministic test data, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_batch(spark: SparkSession, rows: int, seed: int = 0, value: str = "val") -> DataFrame:
    """key: 64 random bits by seed; value: the row's number."""
    return spark.range(rows).select(F.xxhash64("id", F.lit(seed)).alias("key"), F.col("id").cast("int").alias(value))


def nested_batch(spark: SparkSession, rows: int) -> DataFrame:
    """A list of structs and a map of structs, two entries each."""
    i = F.col("id")
    item = lambda k: F.struct((i * 10 + k).alias("item_key"), (i * 0.5 + k).alias("item_value"))
    entry = lambda k: F.struct((i + k).cast("int").alias("count"), ((i + k) % 2 == 0).alias("flag"))
    return spark.range(rows).select("id", (i * 1.5).alias("metric"), F.array(item(0), item(1)).alias("nested_list"), F.create_map(F.lit("a"), entry(0), F.lit("b"), entry(1)).alias("nested_map"))


def float_arrays(spark: SparkSession, rows: int, size: int, seed: int = 0) -> DataFrame:
    """id, values_array (floats in [0, 100)), timestamp (1000 * id)."""
    values = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda j: (F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(1_000_000)) / 10_000).cast("float"))
    return spark.range(rows).select("id", values.alias("values_array"), (F.col("id") * 1000).alias("timestamp"))


def sequence_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
