"""Declarative tasks: a shuffle or co-group of payload files, described by a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..codec.binary import decode
from ..operators import cogroup, exchange
from ..schema.idl import kind_of
from ..sources import frames, tables


def load(spark: SparkSession, spec: dict, thrift: dict | None) -> DataFrame:
    path = tables.stage(spec["path"])
    kind = spec.get("format", "parquet")
    if kind == "parquet":
        return tables.read_folder(spark, path)
    if kind == "csv":
        return tables.read_csv(spark, path)
    raw = frames.read_lines(spark, path, comments=True) if kind == "lines-base64" else frames.read_frames(spark, path, {"raw-len": "big", "raw-len-le": "little"}[kind])
    return decode(raw, kind_of(thrift["text"], thrift["struct"]))


def run(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    """spec: mode (shuffle or cogroup), keyField, left, right, thrift {text, struct}, world, output. Writes and returns the results."""
    left = load(spark, spec["left"], spec.get("thrift"))
    right = load(spark, spec["right"], spec.get("thrift")) if spec.get("right") else None
    world = int(spec.get("world", 8))
    if spec["mode"] == "shuffle":
        out = {"shuffled": exchange.shuffle(left, spec.get("keyField") or left.columns[0], world)}
    elif spec["mode"] == "cogroup":
        left, right, key = cogroup.check_inputs(left, right, spec.get("keyField"))
        out = dict(zip(("left", "right"), cogroup.co_partition(left, right, key, world), strict=True))
    else:
        raise ValueError(f"unknown mode {spec['mode']}")
    for name, df in out.items():
        if spec.get("output"):
            tables.write_folder(df, f"{spec['output']}/{name}", mode="overwrite")
    return out
