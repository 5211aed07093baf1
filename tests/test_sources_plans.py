import base64

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.codec import binary
from millrace.functions import logs, metrics
from millrace.operators import aggregates, cogroup, exchange, rows, windows
from millrace.plans import job_watcher, task
from millrace.schema import idl
from millrace.sources import frames, generators, kafka, tables
from millrace.streaming import pipelines

IDL = "struct P { 1: i64 key, 2: string name }"


def test_parquet_folder(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "id * 1.5D as value", "concat('row_', id) as name")
    tables.write_folder(df, str(tmp_path / "a"), files=3)
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 3 and tables.count_rows(spark, str(tmp_path / "a")) == 300
    assert tables.read_folder(spark, str(tmp_path / "a"), files=True).select("file").distinct().count() == 3
    tables.write_chunks(spark.range(7).coalesce(1), str(tmp_path / "c"), 3)
    assert sorted(spark.read.parquet(str(f)).count() for f in (tmp_path / "c").glob("*.parquet")) == [1, 3, 3]
    (tmp_path / "empty").mkdir()
    assert tables.read_folder(spark, str(tmp_path / "empty"), schema=df.schema).count() == 0
    for call in (lambda: tables.read_folder(spark, str(tmp_path / "none"), schema=df.schema), lambda: tables.read_folder(spark, str(tmp_path / "empty"))):
        with pytest.raises(AnalysisException):
            call()
    with pytest.raises(ValueError):
        tables.write_single(df.limit(0), str(tmp_path / "x"))


def test_frames_and_lines(spark, tmp_path):
    payloads = [b"a", b"", b"xyz"]
    for endian in ("big", "little"):
        (tmp_path / endian).write_bytes(frames.join_frames(payloads, endian))
        assert [bytes(r["payload"]) for r in frames.read_frames(spark, str(tmp_path / endian), endian).orderBy("position").collect()] == payloads
    for bad in (b"\xff\xff\xff\xff", b"\0\0\0\5ab", b"\0\0"):
        with pytest.raises(ValueError):
            list(frames.split_frames(bad))
    (tmp_path / "lines").write_text("# comment\n\n" + "\n".join(base64.b64encode(p).decode() for p in (b"one", b"two")))
    assert sorted(bytes(r["payload"]) for r in frames.read_lines(spark, str(tmp_path / "lines"), comments=True).collect()) == [b"one", b"two"]


def test_task(spark, tmp_path):
    kind = idl.kind_of(IDL, "P")
    (tmp_path / "in").write_bytes(frames.join_frames([binary.encode_value(kind, {"key": i, "name": f"n{i}"}) for i in range(20)]))
    spec = {"mode": "shuffle", "keyField": "key", "left": {"path": str(tmp_path / "in"), "format": "raw-len"}, "thrift": {"text": IDL, "struct": "P"}, "world": 4, "output": str(tmp_path / "out")}
    task.run(spark, spec)
    assert spark.read.parquet(str(tmp_path / "out/shuffled")).count() == 20
    both = task.run(spark, spec | {"mode": "cogroup", "output": None})
    assert both["left"].count() == both["right"].count() == 20
    with pytest.raises(ValueError):
        task.run(spark, spec | {"keyField": "nope"})


def test_exchange_invariants(spark):
    df = generators.random_batch(spark, 10_000, seed=3)
    out = exchange.shuffle(df, "key", 8, exchange.placement)
    assert exchange.misplaced(out, "key", 8).isEmpty() and out.count() == 10_000
    assert out.exceptAll(df).isEmpty() and df.exceptAll(out).isEmpty()
    counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 8 and max(counts) < 1250 * 1.1 and min(counts) > 1250 * 0.9
    assert exchange.shuffle(df, "key", 1).rdd.getNumPartitions() == 1
    nested = generators.nested_batch(spark, 50)
    assert sorted(r["nested_map"]["a"]["count"] for r in exchange.shuffle(nested, "id", 4).collect()) == list(range(50))
    with pytest.raises(ValueError):
        exchange.shuffle(df, "nope", 4)


def test_cogroup_null_and_one_sided_keys(spark):
    left, right = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "key int, a int"), spark.createDataFrame([(2, 20), (None, 21)], "key int, b int")
    assert sorted(map(tuple, cogroup.counts(left, right, "key").collect()), key=str) == [(1, 2, 0), (2, 0, 1), (None, 1, 1)]
    assert {r["key"]: (r["left_rows"], r["right_rows"]) for r in cogroup.nested(left, right, "key", F.col("a"), F.col("b")).collect()} == {1: ([10, 11], []), 2: ([], [20]), None: ([12], [21])}
    assert cogroup.check_inputs(left, None, None)[2] == "key"


def test_windows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, []), (3, None)], "id long, v array<float>")
    got = {r["id"]: (r["a"], r["s"], r["c"]) for r in df.select("id", windows.moving_average(F.col("v"), 2).alias("a"), windows.moving_sum(F.col("v"), 2).alias("s"), windows.moving_count(F.col("v"), 2).alias("c")).collect()}
    assert got == {1: ([1.0, 1.5, 2.5, 3.5], [1.0, 3.0, 5.0, 7.0], [1, 2, 2, 2]), 2: ([], [], []), 3: (None, None, None)}
    assert windows.largest_difference(generators.float_arrays(spark, 20, 30), "id", "values_array", 7).first()["max_diff"] < 1e-9


def test_rows(spark):
    df = spark.createDataFrame([(3, "c", [1]), (1, "a", [])], "k int, s string, l array<int>")
    assert [r["k"] for r in rows.sort_by(df, "k").collect()] == [1, 3] and rows.sort_by(df, "zz") is df
    assert tuple(rows.placeholder(df).first()) == (0, "", []) and rows.union_all([], df).count() == 0
    assert {r["column"]: r["units"] for r in aggregates.column_units(df).collect()} == {"k": 1, "s": 1, "l": 1}
    with pytest.raises(ValueError):
        rows.sort_each_partition(df, "s")


def test_sums_of_doubles_in_any_order(spark):
    values = [69.16, 83.19, 31.11, 52.54]  # added from the left, the last bit is lost
    for own in (values, values[::-1]):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(own)] + [(1, 9, None)], "k int, i int, v double").coalesce(1)
        r = aggregates.gauge_fold(df, ["k"], "v", "i").first()
        assert (r["sum"], r["avg"], r["count"], r["last"]) == (236.0, 59, 4, own[-1])
        assert aggregates.double_fold(df, ["k"], "v").first()["avg"] == 59
    odd = spark.createDataFrame([(1, 1e300), (1, 1e300), (2, 1e-14), (2, 2e-14), (3, float("inf")), (4, float("nan")), (5, None), (6, 1e17), (6, 0.5), (6, -1e17)], "k int, v double")
    got = {r["k"]: str(r["s"]) for r in odd.groupBy("k").agg(aggregates.steady_sum(odd, "v").alias("s")).collect()}
    assert got == {1: "2e+300", 2: "3e-14", 3: "inf", 4: "nan", 5: "None", 6: "0.5"}


def test_histogram_and_logs(spark):
    import struct

    raw = base64.b64encode(struct.pack(">dddq", 6.0, 1.0, 3.0, 3) + b"dig").decode()
    out = metrics.decode_histogram(spark.createDataFrame([(1, raw), (2, None), (3, "AAAA")], "id int, h string"), "h", ["id"]).collect()
    assert (out[0]["sum"], out[0]["count"], bytes(out[0]["digest"])) == (6.0, 3, b"dig") and out[1]["sum"] is None and out[2]["sum"] is None
    lines = ["u.x xenon-pii-prod-001-n2 application_1_2 container_3 2024-01-02 03:04:05 ERROR A.java:1 msg\nmore", "xenon-prod-1-x application_1_2 container_3 2024-01-02 03:04:05 WARN  A.java:1 m", "junk", None]
    got = logs.parse(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert (got[0]["user"], got[0]["cluster"], got[0]["message"], got[0]["timestamp"]) == ("u.x", "xenon-pii-prod-001", "msg\nmore", 1704164645000)
    assert (got[1]["user"], got[1]["level"], got[2]["user"], got[3]["host"]) == ("unknown_user", "WARN", None, None)


def test_job_info_limit_and_merge(spark):
    states = spark.createDataFrame([("a", "c1", None, None, "u", 5), ("a", "c2", "j", None, None, 9)], "app string, cluster string, job_id string, job_name string, user string, last_updated long")
    assert tuple(job_watcher.merge_states(states).first()) == ("a", "c1", "j", None, "u", 9)
    assert {r["jobinfo"] for r in job_watcher.serialized(states, 10).collect()} == {""}


def test_kafka_options():
    got = kafka.options(topics=["metric", "log"], serverset="h1:1\nh2:2\n", max_records=5)
    assert got == {"kafka.bootstrap.servers": "h1:1,h2:2", "subscribe": "metric,log", "startingOffsets": "latest", "maxOffsetsPerTrigger": "5"}
    with pytest.raises(ValueError):
        kafka.options(topics=["t"])


def test_streams(spark, tmp_path):
    source = str(tmp_path / "src")
    spark.createDataFrame([("a", 1, "x", 1.0), ("a", 3, "y", 2.0), ("b", 2, "z", 5.0)], "k string, t long, v string, n double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    got = []
    pipelines.drain(pipelines.latest_by_key(spark.readStream.schema(schema).parquet(source), "k", "t", "v"), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(got) == [("a", 3, "y", 2), ("b", 2, "z", 1)]
    sums = {}
    query = pipelines.drain(pipelines.metric_rollup(spark.readStream.schema(schema).parquet(source), "ts", ["k"], "n"), lambda df, _: sums.update({r["k"]: r["sum"] for r in df.collect()}), str(tmp_path / "c2"))
    query.awaitTermination(120)
    assert sums == {"a": 3.0, "b": 5.0}
