"""Kafka topics as a stream of topic and payload. The connector's jar is the deployment's to provide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec.binary import decode
from ..schema.idl import Kind


def options(servers: str | None = None, topics: list[str] = (), *, serverset: str | None = None, max_records: int | None = None, starting: str = "latest") -> dict[str, str]:
    """Reader options; serverset is the text of a file with one host:port on a line."""
    hosts = servers or ",".join(line.strip() for line in (serverset or "").splitlines() if line.strip())
    if not hosts or not topics:
        raise ValueError("servers and topics are needed")
    out = {"kafka.bootstrap.servers": hosts, "subscribe": ",".join(topics), "startingOffsets": starting}
    if max_records:
        out["maxOffsetsPerTrigger"] = str(max_records)
    return out


def read(spark: SparkSession, **settings) -> DataFrame:
    """topic, payload."""
    return spark.readStream.format("kafka").options(**options(**settings)).load().select("topic", F.col("value").alias("payload"))


def read_decoded(spark: SparkSession, kind: Kind, *, strategy: str = "auto", **settings) -> DataFrame:
    return decode(read(spark, **settings), kind, keep=["topic"], strategy=strategy)
