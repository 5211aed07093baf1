"""Session settings by what they are for; a thin layer over Spark's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(builder: SparkSession.Builder, *, spill_dirs: list[str] | None = None, executor_memory: str | None = None, arrow_batch_rows: int | None = None, partition_bytes: int | None = None) -> SparkSession.Builder:
    """UTC, adaptive execution with skew handling, and what is given of spill folders, memory and batch sizes."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if spill_dirs:
        conf["spark.local.dir"] = ",".join(spill_dirs)
    if executor_memory:
        conf["spark.executor.memory"] = executor_memory
    if arrow_batch_rows:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(arrow_batch_rows)
    if partition_bytes:
        conf["spark.sql.files.maxPartitionBytes"] = str(partition_bytes)
    return builder.config(map=conf)
