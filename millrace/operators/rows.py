"""Row-wise maps, slices, matrices, sorts and unions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_filter(df: DataFrame, keep: Column, *out: Column) -> DataFrame:
    return df.where(keep).select(*out)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A function of one's own over Arrow batches; empty batches are not passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)).num_rows:
                yield out

    return df.mapInArrow(run, schema)


def to_matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("row"))


def from_matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, *[F.get("row", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def slice_rows(df: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def sort_by(df: DataFrame, field: str) -> DataFrame:
    """Sorted by the field; unchanged if there is none."""
    return df.orderBy(field) if field in df.columns else df


def sort_each_partition(df: DataFrame, field: str) -> DataFrame:
    if dict(df.dtypes).get(field) not in ("int", "bigint"):
        raise ValueError(f"{field} is not a whole number")
    return df.sortWithinPartitions(field)


def union_all(frames: list[DataFrame], like: DataFrame | None = None) -> DataFrame:
    """All rows of frames with one schema; none: an empty frame like the given one."""
    if not frames:
        return like.limit(0)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def placeholder(df: DataFrame) -> DataFrame:
    """One row of default values of the frame's schema."""
    default = {"string": F.lit(""), "boolean": F.lit(False)}
    columns = []
    for name, kind in df.dtypes:
        value = default.get(kind, F.array() if kind.startswith("array") else F.create_map() if kind.startswith("map") else F.lit(0))
        columns.append((F.lit(None) if kind.startswith(("struct", "binary", "timestamp", "date")) else value).cast(kind).alias(name))
    return df.sparkSession.range(1).select(*columns)
