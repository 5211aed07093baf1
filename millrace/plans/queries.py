"""The registered queries over the driver's tables; oracles.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import binary
from ..functions import logs, metrics, scopes
from ..operators import aggregates, cogroup, exchange, rows, windows
from ..schema import idl
from ..sources import tables
from . import job_watcher

WORLD = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms, epoch milliseconds."""
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


#: Text in the dialect that both engines share: metric names and log lines made from events.
HOST = "'xenon-' || CASE WHEN event_id % 2 = 0 THEN 'prod' ELSE 'dev' END || '-' || CAST(user_id % 7 AS STRING) || '-n' || CAST(event_id % 5 AS STRING)"
APP = "'application_' || CAST(1000 + user_id % 20 AS STRING) || '_' || CAST(user_id % 10 AS STRING)"
TM = "'container_' || CAST(1000 + user_id % 20 AS STRING) || '_' || CAST(user_id % 10 AS STRING) || '_01_000001'"
JOB = "'job' || CAST(user_id % 50 AS STRING)"
NAMES = [
    f"'flink.jm._t_application_id.' || {APP} || '._t_host.h1._t_job_id.' || {JOB} || '._t_job_name.a-b.uptime'",
    f"'flink.jm._t_application_id.' || {APP} || '._t_host.h1.heap.used'",
    f"'flink.jm._t_host.h1._t_job_id.' || {JOB} || '._t_job_name.a-b.lastCheckpointSize'",
    "'flink.jm._t_host.h1.heap.used'",
    f"'flink.tm._t_host.h1._t_tm_id.' || {TM} || '._t_job_id.' || {JOB} || '._t_job_name.n.latency.source_id.s.operator_id.o.operator_subtask_index.3.p99'",
    f"'flink.tm._t_host.h1._t_tm_id.' || {TM} || '._t_job_id.' || {JOB} || '._t_job_name.n.numRecords'",
    f"'flink.tm._t_host.h1._t_tm_id.' || {TM} || '.Status.JVM'",
    f"'flink.operator._t_host.h1._t_tm_id.' || {TM} || '._t_job_id.' || {JOB} || '._t_job_name.n._t_operator_id.7._t_operator_name.map._t_subtask_index.4.numIn'",
    f"'flink.task._t_host.h1._t_tm_id.' || {TM} || '._t_job_id.' || {JOB} || '._t_job_name.n._t_task_id.t._t_task_name.u._t_task_attempt_id.v._t_task_attempt_num.0._t_subtask_index.5.numOut'",
    "'other.metric.' || event_type",
]
METRIC_NAME = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(NAMES)) + " END"
LEVEL = "CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN ' ELSE 'INFO' END"
PLACE = "CASE WHEN event_id % 4 = 0 THEN 'ExecutionGraph.java:12' ELSE 'Worker.java:7' END"
LOG_LINE = (
    f"CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'u.' || CAST(user_id AS STRING) || ' ' WHEN 3 THEN 'bob ' ELSE 'not a line ' END || CASE WHEN event_id % 5 = 4 THEN event_type ELSE {HOST} || ' ' || {APP} || ' ' || {TM} || ' 2024-01-0' || CAST(1 + event_id % 9 AS STRING)"
    f" || ' 10:00:0' || CAST(event_id % 10 AS STRING) || ' ' || {LEVEL} || ' ' || {PLACE} || ' failed ' || event_type || chr(10) || 'more' END"
)


def groupby_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").count().withColumnRenamed("count", "n")


def moving_avg_array(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", windows.moving_average(F.col("embedding"), 5).alias("avg"), windows.moving_count(F.col("embedding"), 5).alias("cnt"))
    return own.select("vec_id", F.posexplode(F.arrays_zip("avg", "cnt")).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x.avg", 6).alias("avg"), F.col("x.cnt").alias("cnt"))


def moving_avg_rows(spark, sf_dir):
    out = windows.trailing_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    return out.select("event_id", "user_id", F.round("moving_avg", 6).alias("moving_avg"), F.round("moving_sum", 4).alias("moving_sum"), "moving_count")


def moving_avg_global(spark, sf_dir):
    out = windows.trailing_rows(windows.exploded(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), [], ["vec_id", "pos"], "value", 5)
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("moving_avg", 6).alias("moving_avg"))


def moving_avg_verify(spark, sf_dir):
    return windows.largest_difference(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).select((F.col("max_diff") < 1e-5).alias("agrees"))


def array_stats(spark, sf_dir):
    return aggregates.array_stats(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def shuffle_placement(spark, sf_dir):
    out = exchange.shuffle(table(spark, sf_dir, "orders"), "o_orderkey", WORLD, exchange.placement)
    return out.groupBy(F.spark_partition_id().cast("long").alias("dest")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def verify_shuffle(spark, sf_dir):
    out = exchange.shuffle(table(spark, sf_dir, "lineitem"), "l_orderkey", WORLD, exchange.placement)
    return exchange.misplaced(out, "l_orderkey", WORLD).agg(F.count("*").alias("misplaced"))


def shuffle_conservation(spark, sf_dir):
    return exchange.totals(exchange.shuffle(table(spark, sf_dir, "lineitem"), "l_orderkey", WORLD), "l_orderkey")


def placement_alternate(spark, sf_dir):
    out = table(spark, sf_dir, "orders").withColumn("dest", exchange.placement_alternate(F.col("o_custkey"), WORLD).cast("long"))
    return out.groupBy("dest").agg(F.count("*").alias("n"))


def placement_sort(spark, sf_dir):
    return exchange.placement_sort(table(spark, sf_dir, "orders"), "o_orderkey", WORLD).select("o_orderkey", F.col("dest").cast("long").alias("dest"), "pos")


def key_histogram(spark, sf_dir):
    out = exchange.key_histogram(table(spark, sf_dir, "orders"), "o_custkey", F.pmod("o_orderkey", F.lit(4)))
    return out.select("o_custkey", F.concat_ws(",", F.transform("spread", lambda s: F.concat_ws(":", s["rank"].cast("string"), s["n"].cast("string")))).alias("spread"))


def key_index(spark, sf_dir):
    out = aggregates.key_index(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")
    return out.select("n_regionkey", F.concat_ws(",", F.transform("rows", lambda r: r.cast("string"))).alias("rows"))


def rebalance(spark, sf_dir):
    return exchange.totals(exchange.rebalance(table(spark, sf_dir, "orders"), WORLD), "o_orderkey")


def round_robin(spark, sf_dir):
    from ..sources.frames import round_robin as deal

    return deal(table(spark, sf_dir, "events"), "event_id", 3).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))


def salted_count(spark, sf_dir):
    return exchange.salted(table(spark, sf_dir, "events"), "event_type", F.col("event_id")).groupBy("salted_key").agg(F.count("*").alias("n"))


def cogroup_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return cogroup.counts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), lines, "key")


def cogroup_nested(spark, sf_dir):
    out = cogroup.nested(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey"), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey"), "key", F.col("c_custkey"), F.col("s_suppkey"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return out.select("key", text("left_rows"), text("right_rows"))


def cogroup_arrow(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        key = (left if left.num_rows else right).column("key")[0].as_py()
        return pa.table({"key": pa.array([key], pa.int32()), "n_left": pa.array([left.num_rows], pa.int64()), "right_max": pa.array([pc.max(right.column("s_suppkey")).as_py() if right.num_rows else None], pa.int64())})

    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey")
    return cogroup.cogroup(left, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey"), "key", both, "key int, n_left long, right_max long")


def _derived(how):
    def query(spark, sf_dir):
        out = cogroup.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey", how)
        return out.select("c_custkey", *(["o_orderkey"] if how in ("inner", "left", "full") else []))

    return query


def reduce_by_key(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def fold(t: pa.Table) -> pa.Table:
        return pa.table({"l_returnflag": t.column("l_returnflag").slice(0, 1), "n": pa.array([t.num_rows], pa.int64()), "most": pa.array([pc.max(t.column("l_orderkey")).as_py()], pa.int64())})

    return aggregates.reduce(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey"), "l_returnflag", fold, "l_returnflag string, n long, most long")


def reduce_incremental(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    part = lambda cond: lines.where(cond).groupBy("l_partkey").agg(F.sum("l_linenumber").cast("long").alias("total"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))
    return aggregates.merge_partials([part("l_orderkey % 2 = 0"), part("l_orderkey % 2 = 1")], "l_partkey", ["total"], ["low"], ["high"])


def counter_fold(spark, sf_dir):
    return aggregates.counter_fold(table(spark, sf_dir, "events").withColumn("v", F.get_json_object("props", "$.k").cast("long")), ["event_type"], "v")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


def double_counter_fold(spark, sf_dir):
    return _rounded(aggregates.double_fold(table(spark, sf_dir, "events"), ["event_type"], "value"), "sum")


def gauge_fold(spark, sf_dir):
    return _rounded(aggregates.gauge_fold(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts", "event_id"), "sum")


def histogram_fold(spark, sf_dir):
    out = aggregates.histogram_fold(table(spark, sf_dir, "events"), ["event_type"], "value")
    return _rounded(out, "sum", "avg", "p50", "p75", "p90", "p95", "p99", "p999", "p9999")


def sketch_quantiles(spark, sf_dir):
    out = aggregates.sketch_merge(aggregates.sketch_fold(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value"), ["event_type"])
    return out.select("event_type", "count", F.expr("kll_sketch_get_quantile_double(sketch, 0.5D)").alias("p50"))


def _lines(spark, sf_dir):
    folded = aggregates.counter_fold(events(spark, sf_dir).withColumn("v", F.get_json_object("props", "$.k").cast("long")).withColumn("timestamp", F.lit(0)), ["user_id", "event_type", "timestamp"], "v")
    return metrics.put_lines(folded.withColumn("tags", F.concat(F.lit("user="), F.col("user_id"))), "COUNTER", ["event_type", "user_id"], name="event_type")


def put_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def put_batches(spark, sf_dir):
    return metrics.batches(_lines(spark, sf_dir).drop("user_id"), "event_type", "line")


def flatten_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    made = e.select("event_id", F.create_map(F.concat(F.lit("hits a="), F.col("event_type")), k, F.lit("bare"), k + 1).alias("counters"), F.create_map(F.concat(F.lit(" level b="), F.col("user_id"), F.lit(" ")), k.cast("double")).alias("gauges"))
    return metrics.flatten(made, ["event_id"], F.lit("env=x")).select("event_id", "name", "tags", "type", "key", F.expr("cast(cast(value as double) as bigint)").alias("value"))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(METRIC_NAME).alias("metric"))


def scope_classify(spark, sf_dir):
    return _names(spark, sf_dir).select("event_id", scopes.classify(F.col("metric")).alias("scope"))


def scope_extract(spark, sf_dir):
    named = _names(spark, sf_dir).withColumn("scope", scopes.classify(F.col("metric")))
    var = lambda v: scopes.extract(F.col("metric"), F.col("scope"), v).alias(v)
    return named.select("event_id", var("host"), var("tm_id"), var("job_id"), var("job_name"), var("application_id"), var("subtask_index"), scopes.metric_name(F.col("metric"), F.col("scope")).alias("name"))


def app_from_task_manager(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scopes.application_of(F.expr(f"CASE WHEN event_id % 3 = 0 THEN 'a_b_c' ELSE {TM} END")).alias("app"))


def _logs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(LOG_LINE).alias("payload"))


def log_parse(spark, sf_dir):
    return logs.parse(_logs(spark, sf_dir), "payload").select("event_id", "user", "host", "application_id", "container_id", "timestamp", "level", "place", "message", "cluster")


def cleanup_filter(spark, sf_dir):
    e = events(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("ms").alias("timestamp"), F.lit("h").alias("host"), F.expr(METRIC_NAME).alias("metricName"), F.lit("1").alias("metricValue")))
    raw = e.select(F.lit("metric").alias("topic"), payload.alias("payload")).unionByName(_logs(spark, sf_dir).select(F.lit("log").alias("topic"), "payload"))
    return job_watcher.cleanup(raw).groupBy("type", "appid", "jobid").agg(F.count("*").alias("n"))


def _signals(spark, sf_dir):
    e = events(spark, sf_dir)
    null = F.lit(None).cast("string")
    return e.select(
        F.concat(F.lit("App_"), F.col("user_id")).alias("app"), F.col("ms").alias("timestamp"), F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("event_id"))).otherwise(null).alias("cluster"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("job"), F.col("user_id") % 50)).alias("job_id"),
        F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("job_name"), F.when(F.col("event_id") % 2 == 0, F.lit("u")).alias("user"),
    )


def _now(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("ms")).scalar()


def app_state(spark, sf_dir):
    return job_watcher.app_state(_signals(spark, sf_dir), _now(spark, sf_dir), 3 * job_watcher.DAY_MS)


def app_exceptions(spark, sf_dir):
    rows_ = events(spark, sf_dir).select(F.col("user_id").alias("app"), F.col("ms").alias("timestamp"), F.col("event_id").alias("id"), F.expr(PLACE).alias("place"))
    return job_watcher.exceptions(rows_).select("app", F.concat_ws(",", F.transform("exceptions", lambda x: x.cast("string"))).alias("exceptions"))


def _job_metrics(spark, sf_dir):
    name = "CASE event_id % 6 WHEN 0 THEN 'uptime' WHEN 1 THEN 'fullRestarts' WHEN 2 THEN 'numRestarts' WHEN 3 THEN 'lastCheckpointSize' WHEN 4 THEN 'lastCheckpointExternalPath' ELSE 'numberOfFailedCheckpoints' END"
    return events(spark, sf_dir).select(F.concat(F.lit("job"), F.col("user_id") % 50).alias("jobid"), F.col("ms").alias("timestamp"), F.col("event_id").alias("id"), F.expr(name).alias("name"), F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("value"))


def _job_state(spark, sf_dir):
    return job_watcher.job_state(_job_metrics(spark, sf_dir)).withColumn("paths", F.concat_ws(",", "paths"))


def job_state(spark, sf_dir):
    return _job_state(spark, sf_dir)


def job_info(spark, sf_dir):
    states = job_watcher.app_state(_signals(spark, sf_dir), _now(spark, sf_dir), 10_000 * job_watcher.DAY_MS)
    return job_watcher.job_info(states, _job_state(spark, sf_dir)).select("app", "job_id", "last_updated", "uptime", "restarts", "failed_checkpoints", "checkpoint_size", "paths")


def job_info_json(spark, sf_dir):
    states = job_watcher.app_state(_signals(spark, sf_dir), _now(spark, sf_dir), 10_000 * job_watcher.DAY_MS)
    return job_watcher.serialized(job_watcher.job_info(states, _job_state(spark, sf_dir)))


def ttl_filter(spark, sf_dir):
    return windows.recent(events(spark, sf_dir), "ms", _now(spark, sf_dir), job_watcher.DAY_MS).select("event_id", "ms")


def key_window(spark, sf_dir):
    out = windows.key_window(events(spark, sf_dir), "user_id", "ms", _now(spark, sf_dir), 5 * job_watcher.DAY_MS, "event_id")
    return out.select("user_id", F.concat_ws(",", F.transform("rows", lambda r: r["event_id"].cast("string"))).alias("rows"))


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def union_all(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return rows.union_all([n, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), n])


def sort_limit(spark, sf_dir):
    return rows.slice_rows(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 5, 10).select("o_orderkey", "o_custkey")


def topk_latest(spark, sf_dir):
    return aggregates.top_k(table(spark, sf_dir, "events"), ["user_id"], 3, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


def column_units(spark, sf_dir):
    return aggregates.column_units(table(spark, sf_dir, "part"))


def row_map_filter(spark, sf_dir):
    return rows.map_filter(table(spark, sf_dir, "lineitem"), (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "R"), F.col("l_orderkey"), (F.col("l_linenumber") * 10).cast("long").alias("scaled"))


def batch_function(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def double(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = batch.filter(pc.equal(pc.bit_wise_and(batch.column(0), 1), 0))
        return pa.RecordBatch.from_arrays([kept.column(0), pc.multiply(kept.column(0), 2)], ["o_orderkey", "twice"])

    return rows.map_batches(table(spark, sf_dir, "orders").select("o_orderkey"), double, "o_orderkey long, twice long")


def matrix_roundtrip(spark, sf_dir):
    columns = ["l_linenumber", "l_quantity"]
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rows.from_matrix(rows.to_matrix(lines, "id", columns), "id", columns)


def bench_stats(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.when(F.col("event_id") % 10 == 0, "time_s").otherwise(F.col("event_id").cast("string")).alias("time_s"), F.col("user_id").cast("string").alias("rows_per_sec"))
    return _rounded(aggregates.bench_stats(made, ["mode"]), "avg_time", "avg_rate")


def sample_dump(spark, sf_dir):
    return tables.sample_lines(table(spark, sf_dir, "region").orderBy("r_regionkey"), 5)


METRICS_IDL = """
struct Metrics {
  1: required i64 timestamp, 2: optional string service_tags, 3: optional string node_tags,
  4: optional map<string, i64> counters, 5: optional map<string, double> gauges, 6: optional map<string, string> histograms,
  7: optional string service_name; 8: optional map<string, double> double_counters
}
"""


def _payloads(spark, sf_dir):
    e = events(spark, sf_dir)
    made = e.select("event_id", F.col("ms").alias("timestamp"), F.col("event_type").alias("service_name"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("long"), F.lit("id"), F.col("event_id")).alias("counters"), F.when(F.col("event_id") % 4 > 0, F.create_map(F.lit("v"), F.col("value"))).alias("gauges"))
    return binary.encode(made, idl.kind_of(METRICS_IDL, "Metrics"), keep=["event_id"])


def thrift_roundtrip(spark, sf_dir):
    out = binary.decode(_payloads(spark, sf_dir), idl.kind_of(METRICS_IDL, "Metrics"), keep=["event_id"])
    return out.select("event_id", "timestamp", "service_name", F.col("counters")["k"].alias("k"), F.col("counters")["id"].alias("id"), F.col("gauges")["v"].alias("v"), "node_tags")


def thrift_groupby(spark, sf_dir):
    out = binary.decode(_payloads(spark, sf_dir), idl.kind_of(METRICS_IDL, "Metrics"), fields=["service_name", "timestamp"])
    return tables.names_and_times(out).groupBy("service_name").agg(F.count("*").alias("n"), F.max("timestamp").alias("latest"))


DEEP_IDL = """
struct Reading { 1: i64 ts, 2: double value, 3: list<string> notes }
struct Meta { 1: map<string, string> labels }
struct Region { 1: string country, 2: string city }
struct Geo { 1: double lat, 2: double lon, 3: Region region }
struct Deep {
  1: i64 event_id, 2: string source, 3: list<list<i32>> metrics, 4: set<i64> label_ids, 5: map<string, list<i64>> counts_by_key,
  6: Meta meta, 7: list<Reading> readings, 10: Geo geo
}
"""


def deep_event_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    uid, eid = F.col("user_id"), F.col("event_id")
    reading = lambda n: F.struct(F.col("ms").alias("ts"), F.col("value").alias("value"), F.array(F.lit(f"n{n}")).alias("notes"))
    labels = F.when(eid % 2 == 0, F.create_map(F.lit("region"), F.concat(F.lit("r"), uid % 3))).otherwise(F.create_map(F.lit("zone"), F.lit("z")))
    made = e.select(
        eid, F.concat(F.lit("src-"), eid % 10).alias("source"), F.array(F.array((uid % 7).cast("int"), F.lit(2)), F.array((eid % 5).cast("int"))).alias("metrics"), F.array(uid, uid, eid).alias("label_ids"),
        F.create_map(F.lit("a"), F.array(eid, uid)).alias("counts_by_key"), F.struct(labels.alias("labels")).alias("meta"), F.when(eid % 3 == 0, F.array(reading(1))).otherwise(F.array(reading(1), reading(2))).alias("readings"),
        F.struct(F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.struct(F.lit("US").alias("country"), F.when(eid % 2 == 0, "NYC").alias("city")).alias("region")).alias("geo"),
    )
    kind = idl.kind_of(DEEP_IDL, "Deep")
    deep = binary.decode(binary.encode(made, kind), kind)
    return deep.select(
        "event_id", F.size("readings").cast("long").alias("n_readings"), F.coalesce(F.col("meta.labels")["region"], F.lit("n/a")).alias("region"), F.col("metrics")[0][0].alias("first_metric"),
        F.size("label_ids").cast("long").alias("n_labels"), F.col("counts_by_key")["a"][1].alias("second_count"), F.col("geo.region.city").alias("city"), F.element_at("readings", -1)["notes"][0].alias("last_note"),
    )


def flatten_struct(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    nested = o.select(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("who")).alias("head"), F.array(F.struct(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))).alias("items"))
    out = nested.select(*idl.flatten(nested.schema, flatten_list=True))
    return out.select("head_id", "head_who_key", "head_who_status", F.col("items_c")[0].alias("c"), F.col("items_o")[0].alias("o"))


def destinations(spark, sf_dir):
    return exchange.destinations(table(spark, sf_dir, "supplier"), "s_suppkey", WORLD).select("s_suppkey", F.col("_hash").cast("long").alias("dest"))


def random_k(spark, sf_dir):
    return aggregates.random_k(table(spark, sf_dir, "customer"), 10, 7, "c_custkey").select("c_custkey")


def k_means(spark, sf_dir):
    _, out = aggregates.k_means(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), 3, ["l_quantity", "l_extendedprice"], 10, 1)
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


def fill_job(spark, sf_dir):
    states = job_watcher.app_state(_signals(spark, sf_dir), _now(spark, sf_dir), 10_000 * job_watcher.DAY_MS)
    lines = events(spark, sf_dir).select(F.concat(F.lit("APP_"), F.col("user_id")).alias("appid"), F.when(F.col("event_id") % 2 == 0, F.lit("own")).alias("jobid"), "event_id")
    return job_watcher.fill_job(lines, states).select("event_id", "jobid")


QUERIES = {
    f.__name__: f
    for f in (
        groupby_count, moving_avg_array, moving_avg_rows, moving_avg_global, moving_avg_verify, array_stats, shuffle_placement, verify_shuffle, shuffle_conservation, placement_alternate,
        placement_sort, destinations, key_histogram, key_index, rebalance, round_robin, salted_count, cogroup_counts, cogroup_nested, cogroup_arrow, reduce_by_key, reduce_incremental, counter_fold,
        double_counter_fold, gauge_fold, histogram_fold, sketch_quantiles, put_lines, put_batches, flatten_metrics, scope_classify, scope_extract, app_from_task_manager, log_parse, cleanup_filter,
        app_state, app_exceptions, job_state, job_info, job_info_json, fill_job, ttl_filter, key_window, json_extract, union_all, sort_limit, topk_latest, column_units, row_map_filter, batch_function,
        matrix_roundtrip, bench_stats, sample_dump, thrift_roundtrip, thrift_groupby, deep_event_summary, flatten_struct, random_k, k_means,
    )
} | {f"cogroup_{how}": _derived(how) for how in ("inner", "left", "full", "semi", "anti")}
