"""Payloads in files: length-prefixed frames and lines of base64."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_frames(raw: bytes, endian: str = "big") -> Iterator[bytes]:
    """Frames behind 4-byte lengths; a clean end stops, a negative or too long frame is an error."""
    at = 0
    while at < len(raw):
        if at + 4 > len(raw):
            raise ValueError("a length is cut off")
        n = int.from_bytes(raw[at : at + 4], endian, signed=True)
        if n < 0 or at + 4 + n > len(raw):
            raise ValueError(f"bad frame of {n} bytes")
        yield raw[at + 4 : at + 4 + n]
        at += 4 + n


def join_frames(payloads, endian: str = "big") -> bytes:
    return b"".join(len(p).to_bytes(4, endian, signed=True) + p for p in payloads)


def explode_frames(df: DataFrame, keep: list[str], content: str = "content", endian: str = "big") -> DataFrame:
    """keep, position, payload: a row for each frame of the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in enumerate(batch.column(len(keep))):
                frames = list(split_frames(raw.as_py() or b"", endian))
                for at in range(0, len(frames), 10_000):
                    some = frames[at : at + 10_000]
                    of = pa.array([row] * len(some), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(len(keep))), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.binary())], [*keep, "position", "payload"])

    return df.select(*keep, content).mapInArrow(run, T.StructType([df.schema[c] for c in keep]).add("position", "long").add("payload", "binary"))


def read_frames(spark: SparkSession, path: str, endian: str = "big") -> DataFrame:
    """file, position, payload. Files are read whole, so they should be of moderate size."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return explode_frames(files, ["file"], endian=endian)


def pack(df: DataFrame, group: str, order: str, payload: str = "payload", endian: str = "big") -> DataFrame:
    """group, content: the payloads of a group as frames, in order. A group is one value: it should be of moderate size."""
    size = F.lpad(F.hex(F.octet_length(payload)), 8, "0")
    if endian == "little":
        size = F.concat(*[F.substring(size, i, 2) for i in (7, 5, 3, 1)])
    frame = F.struct(F.col(order).alias("at"), F.concat(size, F.hex(payload)).alias("digits"))
    return df.groupBy(group).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(frame)), lambda f: f["digits"]), "")).alias("content"))


def read_lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """payload of each non-empty line of base64; with comments, lines that start with # are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        lines = lines.where(~F.startswith(F.trim("value"), F.lit("#")))
    return lines.select(F.unbase64(F.trim("value")).alias("payload"))


def round_robin(df: DataFrame, index: str, n: int) -> DataFrame:
    """part: which of n receives the row, by its index."""
    return df.withColumn("part", F.pmod(F.col(index), F.lit(n)).cast("int"))
