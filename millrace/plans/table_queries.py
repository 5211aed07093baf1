"""Registered queries of sources, sinks, schemas and streams, each beside its SQL: what is written is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import binary
from ..operators import aggregates
from ..schema import idl
from ..sources import frames, tables
from ..streaming import pipelines
from .oracles import _JOB_STATE, _STATE, MS
from .queries import METRICS_IDL, _payloads, _signals, events, table

# -- folders and files ----------------------------------------------------------------------------------------------


def parquet_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "folder")
    tables.write_folder(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, files=3)
    return tables.read_folder(spark, path)


def parquet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "files")
    tables.write_folder(table(spark, sf_dir, "orders").select("o_orderkey"), path, files=3)
    return tables.read_folder(spark, path, files=True).agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_rows"))


def parquet_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(tables.count_rows(spark, f"{sf_dir}/lineitem.parquet"),)], "n long")


def parquet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "chunks")
    tables.write_chunks(table(spark, sf_dir, "nation").coalesce(1), path, 7)
    return tables.read_folder(spark, path, files=True).groupBy("file").agg(F.count("*").alias("n")).select("n")


def named_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "named")
    tables.write_batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, "batch", 4, "o_orderkey")
    own = tables.read_folder(spark, path, files=True).withColumn("name", F.regexp_extract("file", r"(batch_\d{5})\.parquet$", 1))
    return own.groupBy("name").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "csv")
    tables.append_benchmark(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return tables.read_csv(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def benchmark_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "bench")
    for _ in range(2):
        tables.append_benchmark(table(spark, sf_dir, "region").select(F.col("r_name").alias("mode"), F.lit(7).alias("time_s")), path)
    return tables.read_csv(spark, path).select("mode", F.col("time_s").cast("long").alias("time_s"))


def decoded_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "decoded")
    tables.write_names_and_times(binary.decode(_payloads(spark, sf_dir), idl.kind_of(METRICS_IDL, "Metrics"), fields=["service_name", "timestamp"]), path)
    return tables.read_folder(spark, path)


def decoded_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "decoded-csv")
    tables.write_names_and_times(binary.decode(_payloads(spark, sf_dir), idl.kind_of(METRICS_IDL, "Metrics"), fields=["service_name", "timestamp"]), path, "csv")
    return tables.read_csv(spark, path).select("service_name", F.col("timestamp").cast("long").alias("timestamp"))


# -- payloads -------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("block"), F.encode(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), "utf-8").alias("payload"))


def _frames(endian: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = frames.pack(_texts(spark, sf_dir), "block", "event_id", endian=endian)
        return frames.explode_frames(packed, ["block"], endian=endian).select("block", "position", F.col("payload").cast("string").alias("text"))

    return query


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 4-byte lengths, each file a row of packed frames, told by a checksum of the payloads in their order."""
    packed = frames.pack(_texts(spark, sf_dir), "block", "event_id")
    out = frames.explode_frames(packed, ["block"])
    return out.groupBy("block").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.sum(F.octet_length("payload")).alias("bytes"))


def base64_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "lines")
    lines = _texts(spark, sf_dir).select(F.base64("payload").alias("value"))
    lines.unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return frames.read_lines(spark, path, comments=True).select(F.col("payload").cast("string").alias("text"))


# -- schemas --------------------------------------------------------------------------------------------------------


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = idl.schema_of(METRICS_IDL, "Metrics")
    ids = {i: n for n, i in idl.id_map(own).items()}
    return spark.createDataFrame([(ids[i], f.name, f.dataType.simpleString()) for i, f in enumerate(own.fields)], "id long, name string, kind string")


def flatten_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("a"), F.struct(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))).alias("items"))
    out = nested.select(*idl.flatten(nested.schema, flatten_map=True))
    return out.select("o_orderkey", F.col("items_c")["a"].alias("c"), F.col("items_s")["a"].alias("s"))


# -- sketches and samples -------------------------------------------------------------------------------------------


def sketch_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the share of values up to the merged sketch's median is within 3 % of one half."""
    e = table(spark, sf_dir, "events")
    merged = aggregates.sketch_merge(aggregates.sketch_fold(e, ["event_type", "user_id"], "value"), ["event_type"])
    medians = merged.select("event_type", F.expr("kll_sketch_get_quantile_double(sketch, 0.5D)").alias("median"))
    share = F.avg(F.when(F.col("value") <= F.col("median"), 1.0).otherwise(0.0))
    return e.join(medians, "event_type").groupBy("event_type").agg((F.abs(share - 0.5) <= 0.03).alias("within"))


def random_k_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = aggregates.random_k(table(spark, sf_dir, "customer"), 10, 7, "c_custkey").select("c_custkey")
    return drawn.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_distinct"))


# -- streams --------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows as a stream of several micro-batches."""
    path = tables.scratch(spark, "stream")
    tables.write_folder(rows, path, files=3)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "update") -> DataFrame:
    """What all micro-batches gave, with the number of each in `batch`."""
    path = tables.scratch(spark, "drained")
    sink = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(path)
    pipelines.drain(stream, sink, tables.scratch(spark, "progress"), mode).awaitTermination()
    return spark.read.parquet(path)


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table after the last micro-batch, as every batch gives it anew."""
    rolled = pipelines.metric_rollup(_streamed(spark, table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "ts", ["event_type"], "value", late="3650 days")
    own = _drained(spark, rolled, "complete")
    last = own.agg(F.max("batch").alias("batch"))
    return own.join(F.broadcast(last), "batch").select(F.unix_millis("window.start").alias("start"), "event_type", F.round("sum", 4).alias("sum"), "min", "max", "count")


def stream_app_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(spark, pipelines.app_states(_streamed(spark, _signals(spark, sf_dir)), ttl_ms=None))
    columns = ["cluster", "job_id", "job_name", "user", "last_updated"]
    return out.groupBy("app").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("app", "s.*")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "ms", "event_id")
    out = _drained(spark, pipelines.latest_by_key(_streamed(spark, rows), "user_id", "ms", "event_id", ttl_ms=None))
    return out.groupBy("key").agg(F.max("n").alias("n"), F.max("last_updated").alias("last_updated"))


def stream_line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines leave the buffer 250 at a time; the rest waits."""
    lines = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("put a "), F.col("event_id").cast("string")).alias("line"))
    out = _drained(spark, pipelines.line_buffer(_streamed(spark, lines), "event_type", "line", 250), "append")
    return out.groupBy("key").agg(F.count("*").alias("batches"), F.sum("n").alias("lines"))


QUERIES = {
    f.__name__: f
    for f in (
        parquet_folder, parquet_files, parquet_row_count, parquet_chunks, named_batches, csv_roundtrip, benchmark_append, decoded_to_parquet, decoded_to_csv, frame_files, base64_lines, schema_fields,
        flatten_maps, sketch_error, random_k_members, stream_rollup, stream_app_state, stream_latest, stream_line_batches,
    )
} | {"frames_big": _frames("big"), "frames_little": _frames("little")}

_FRAMES = "SELECT event_id // 1000 AS block, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS position, event_type || ':' || event_id AS text FROM events"


def _json_field(name: str, text: bool) -> str:
    return f"""CASE WHEN "{name}" IS NOT NULL THEN '"{name}":' || {f"'" + '"' + f"' || \"{name}\" || '" + '"' + "'" if text else f'"{name}"'} END"""


_JSON = [_json_field(n, t) for n, t in (("app", 1), ("cluster", 1), ("job_id", 1), ("job_name", 1), ("user", 1), ("last_updated", 0), ("uptime", 0), ("restarts", 0), ("failed_checkpoints", 0), ("checkpoint_size", 0), ("paths", 1))]

ORACLES = {
    "parquet_folder": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "parquet_files": "SELECT 3::BIGINT AS n_files, count(*) AS n_rows FROM orders",
    "parquet_row_count": "SELECT count(*) AS n FROM lineitem",
    "parquet_chunks": "SELECT count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS chunk FROM nation) GROUP BY chunk",
    "named_batches": """SELECT 'batch_' || lpad(part::VARCHAR, 5, '0') AS name, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high
        FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // CAST(ceil((SELECT count(*) FROM orders) / 4) AS BIGINT) AS part FROM orders) GROUP BY part""",
    "csv_roundtrip": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "benchmark_append": "SELECT r_name AS mode, 7::BIGINT AS time_s FROM region UNION ALL SELECT r_name, 7 FROM region",
    "decoded_to_parquet": f"SELECT event_type AS service_name, {MS} AS timestamp FROM events",
    "decoded_to_csv": f"SELECT event_type AS service_name, {MS} AS timestamp FROM events",
    "frame_files": "SELECT event_id // 1000 AS block, count(*) AS n, count(*) - 1 AS last, sum(strlen(event_type || ':' || event_id))::BIGINT AS bytes FROM events GROUP BY 1",
    "base64_lines": "SELECT event_type || ':' || event_id AS text FROM events",
    "schema_fields": """SELECT * FROM (VALUES (1::BIGINT, 'timestamp', 'bigint'), (2, 'service_tags', 'string'), (3, 'node_tags', 'string'), (4, 'counters', 'map<string,bigint>'), (5, 'gauges', 'map<string,double>'),
        (6, 'histograms', 'map<string,string>'), (7, 'service_name', 'string'), (8, 'double_counters', 'map<string,double>')) AS t(id, name, kind)""",
    "flatten_maps": "SELECT o_orderkey, o_custkey AS c, o_orderstatus AS s FROM orders",
    "sketch_error": "SELECT event_type, true AS within FROM events GROUP BY 1",
    "random_k_members": "SELECT least(10, count(*)) AS n, least(10, count(*)) AS n_distinct FROM customer",
    "stream_rollup": "SELECT epoch_ms(date_trunc('hour', ts)) AS start, event_type, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS count FROM events GROUP BY 1, 2",
    "stream_app_state": _STATE,
    "stream_latest": f"SELECT user_id::VARCHAR AS key, count(*) AS n, max({MS}) AS last_updated FROM events GROUP BY 1",
    "stream_line_batches": "SELECT event_type AS key, count(*) // 250 AS batches, count(*) // 250 * 250 AS lines FROM events GROUP BY 1 HAVING count(*) >= 250",
    "frames_big": _FRAMES,
    "frames_little": _FRAMES,
    "job_info_json": f"SELECT '{{' || concat_ws(',', {', '.join(_JSON)}) || '}}' AS jobinfo FROM ({_STATE}) s LEFT JOIN ({_JOB_STATE}) j ON s.job_id = j.jobid",
}
