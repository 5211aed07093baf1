"""Application metrics: maps to rows, keys, time-series lines."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The maps of a payload and the type that each holds.
MAPS = {"counters": "COUNTER", "gauges": "GAUGE", "histograms": "HISTOGRAM", "double_counters": "DOUBLE_COUNTER"}


def name_of(key: Column) -> Column:
    """`name tags` up to the first space; a key without a space has neither name nor tags."""
    return F.when(F.instr(F.trim(key), " ") > 0, F.substring_index(F.trim(key), " ", 1)).otherwise("")


def tags_of(key: Column, extra: Column) -> Column:
    """What follows the first space, with the extra tags appended."""
    whole = F.trim(F.concat_ws(" ", F.trim(key), extra))
    return F.when(F.instr(F.trim(key), " ") > 0, F.ltrim(F.substr(whole, F.instr(whole, " ") + 1))).otherwise("")


def composite_key(name: Column, tags: Column, kind: Column) -> Column:
    return F.concat_ws("#", name, tags, kind)


def flatten(df: DataFrame, keys: list[str], tags: Column) -> DataFrame:
    """A row for each entry of the four maps: keys, name, tags, type, key, value (as text)."""
    parts = None
    for column, kind in MAPS.items():
        if column not in df.columns:
            continue
        rows = df.select(*keys, tags.alias("_extra"), F.explode(column).alias("_key", "_value"))
        rows = rows.select(*keys, name_of(F.col("_key")).alias("name"), tags_of(F.col("_key"), F.col("_extra")).alias("tags"), F.lit(kind).alias("type"), F.col("_value").cast("string").alias("value"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.withColumn("key", composite_key(F.col("name"), F.col("tags"), F.col("type")))


#: Line names by type, as (prefix, suffix, column). Lines of null columns are left out.
LINES = {
    "COUNTER": [("mabs.counters.", "", "sum"), ("mabs_agg.counters.", ".sum", "sum"), ("mabs_agg.counters.", ".max", "max"), ("mabs_agg.counters.", ".min", "min"), ("mabs_agg.counters.", ".avg", "avg"), ("mabs_agg.counters.", ".count", "count")],
    "DOUBLE_COUNTER": [("mabs.double_counters.", "", "sum"), ("mabs_agg.double_counters.", ".sum", "sum"), ("mabs_agg.double_counters.", ".max", "max"), ("mabs_agg.double_counters.", ".min", "min"), ("mabs_agg.double_counters.", ".avg", "avg"), ("mabs_agg.double_counters.", ".count", "count")],
    "GAUGE": [("mabs.gauges.", "", "last"), ("mabs.gauges.", ".last", "last"), ("mabs_agg.gauges.", ".max", "max"), ("mabs_agg.gauges.", ".min", "min"), ("mabs_agg.gauges.", ".sum", "sum"), ("mabs_agg.gauges.", ".avg", "avg"), ("mabs_agg.gauges.", ".count", "count")],
    "HISTOGRAM": [("mabs.histograms.", f".{c}", c) for c in ("p50", "p75", "p90", "p95", "p99", "p999", "p9999", "sum", "count", "avg", "max", "min")],
}


def put_lines(folded: DataFrame, kind: str, keys: list[str], name: str = "name", time: str = "timestamp", tags: str = "tags") -> DataFrame:
    """keys and `line`: `put <name> <time> <value> <tags>` for each value of a folded metric."""
    lines = [
        F.when(F.col(c).isNotNull(), F.concat_ws(" ", F.lit("put"), F.concat(F.lit(prefix), F.col(name), F.lit(suffix)), F.col(time).cast("string"), F.col(c).cast("string"), F.col(tags)))
        for prefix, suffix, c in LINES[kind]
    ]
    return folded.select(*keys, F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line"))


def batches(lines: DataFrame, group: str, order: str, size: int = 250) -> DataFrame:
    """group, batch, lines: runs of `size` lines in order, joined by newlines; the last may be shorter.

    Lines are numbered within a group, so that one task does not number them all.
    """
    numbered = lines.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("long"))
    joined = F.concat_ws("\n", F.array_sort(F.collect_list("line")))
    return numbered.groupBy(group, "batch").agg(joined.alias("lines"), F.count("*").alias("n"))


def decode_histogram(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, sum, min, max, count, digest of base64 text: three big-endian doubles, a long, the digest. Bad input: nulls."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = struct.Struct(">dddq")
        for batch in parts:
            rows = []
            for raw in batch.column(len(keep)).to_pylist():
                ok = raw is not None and len(raw) >= form.size
                rows.append((*form.unpack_from(raw), raw[form.size :]) if ok else (None,) * 5)
            kinds = [pa.float64()] * 3 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*keep, "sum", "min", "max", "count", "digest"])

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", sum double, min double, max double, count long, digest binary"
    return df.select(*keep, F.unbase64(column).alias("_raw")).mapInArrow(run, schema)
