"""Job health: raw metrics and logs to application states, job states and job summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logs, scopes
from ..operators.aggregates import top_k

METRIC = "timestamp long, host string, metricName string, metricValue string"
#: Fixed values.
UNKNOWN_APPLICATION = "application_unknown"
CRITICAL = "ExecutionGraph"
KEEP_EXCEPTIONS, KEEP_PATHS, MAX_JSON = 20, 3, 6_000_000
DAY_MS = 24 * 3600 * 1000


def parse_metrics(raw: DataFrame) -> DataFrame:
    """topic, payload (JSON) -> timestamp, host, type, name, value, application_id, job_id, job_name. Bad rows have nulls."""
    m = raw.select(F.from_json("payload", METRIC).alias("m")).select("m.*")
    m = m.withColumn("type", scopes.classify(F.col("metricName")))
    var = lambda v: F.nullif(scopes.extract(F.col("metricName"), F.col("type"), v), F.lit(""))
    return m.select(
        "timestamp", "host", "type", scopes.metric_name(F.col("metricName"), F.col("type")).alias("name"), F.col("metricValue").alias("value"),
        F.coalesce(var("application_id"), scopes.application_of(var("tm_id"))).alias("application_id"), var("job_id").alias("job_id"), var("job_name").alias("job_name"),
    )


def cleanup(raw: DataFrame) -> DataFrame:
    """topic, payload -> jobid, appid, type, json.

    Metrics of job managers with a job and a known application, and ERROR logs of a known application.
    """
    known = F.col("application_id").isNotNull() & (F.col("application_id") != UNKNOWN_APPLICATION)
    metrics = parse_metrics(raw.where("topic = 'metric'")).where(F.col("type").isin(*scopes.JOB_MANAGER) & known & F.col("job_id").isNotNull())
    metric = F.to_json(F.struct("timestamp", "host", "type", "name", "value", "application_id", "job_id", "job_name"))
    errors = logs.parse(raw.where("topic = 'log'"), "payload").where((F.col("level") == "ERROR") & known)
    log = F.to_json(F.struct("timestamp", "user", "host", "cluster", "application_id", "container_id", "level", "place", "message"))
    return metrics.select(F.col("job_id").alias("jobid"), F.col("application_id").alias("appid"), F.lit("metric").alias("type"), metric.alias("json")).unionByName(
        errors.select(F.lit(None).cast("string").alias("jobid"), F.col("application_id").alias("appid"), F.lit("log").alias("type"), log.alias("json"))
    )


def app_state(signals: DataFrame, now: Column, ttl_ms: int = DAY_MS) -> DataFrame:
    """app, cluster, job_id, job_name, user, last_updated: the first known value of each by (timestamp, id), the latest time.

    signals: app, timestamp, id and the four values. Keys are lower-cased; states not updated for ttl_ms are left out.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("timestamp", "id"))).alias(c)
    state = signals.withColumn("app", F.lower("app")).groupBy("app").agg(*map(first, ("cluster", "job_id", "job_name", "user")), F.max("timestamp").alias("last_updated"))
    return state.where(F.col("last_updated") >= now - ttl_ms)


def merge_states(states: DataFrame) -> DataFrame:
    """Partial states of one application folded by the same rules; earlier states come first."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("last_updated"))).alias(c)
    return states.groupBy("app").agg(*map(first, ("cluster", "job_id", "job_name", "user")), F.max("last_updated").alias("last_updated"))


def exceptions(logs_: DataFrame, keep: int = KEEP_EXCEPTIONS) -> DataFrame:
    """app, exceptions: the newest critical ones, oldest first, then the newest others likewise. logs_: app, timestamp, id, place."""
    rows = logs_.withColumn("regular", ~F.contains("place", F.lit(CRITICAL)))
    kept = top_k(rows, ["app", "regular"], keep, F.desc("timestamp"), F.desc("id"))
    return kept.groupBy("app").agg(F.transform(F.array_sort(F.collect_list(F.struct("regular", "timestamp", "id"))), lambda e: e["id"]).alias("exceptions"))


def job_state(metrics: DataFrame) -> DataFrame:
    """jobid, uptime, restarts, failed_checkpoints, checkpoint_size, checkpoint_duration, paths (the newest three, newest first).

    metrics: jobid, timestamp, id, name, value (text). The last value by (timestamp, id) counts; text that is no number does not.
    """
    number = F.expr("try_cast(value as bigint)")
    last = lambda *names: F.max_by(number, F.when(F.col("name").isin(*names) & number.isNotNull(), F.struct("timestamp", "id")))
    path = F.when(F.col("name") == "lastCheckpointExternalPath", F.struct("timestamp", "id", "value"))
    # The paths of a job are cut to three before they are gathered.
    others = metrics.groupBy("jobid").agg(
        last("uptime").alias("uptime"), last("fullRestarts", "numRestarts").alias("restarts"), last("numberOfFailedCheckpoints").alias("failed_checkpoints"),
        last("lastCheckpointSize").alias("checkpoint_size"), last("lastCheckpointDuration").alias("checkpoint_duration"),
    )
    newest = top_k(metrics.where(path.isNotNull()), ["jobid"], KEEP_PATHS, F.desc("timestamp"), F.desc("id"))
    paths = newest.groupBy("jobid").agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "id", "value")), asc=False), lambda p: p["value"]).alias("paths"))
    return others.join(paths, "jobid", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def job_info(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each state with its job's figures, null where the job has none. states: job_id and more."""
    return states.join(jobs, states["job_id"] == jobs["jobid"], "left").drop("jobid")


def serialized(info: DataFrame, limit: int = MAX_JSON) -> DataFrame:
    """jobinfo: the row as JSON, empty if longer than the limit."""
    text = F.to_json(F.struct(*info.columns))
    return info.select(F.when(F.length(text) > limit, "").otherwise(text).alias("jobinfo"))


def fill_job(rows: DataFrame, states: DataFrame) -> DataFrame:
    """jobid from the application's state where a row has none. rows: appid, jobid."""
    own = states.select(F.col("app").alias("_app"), F.col("job_id").alias("_job"))
    return rows.join(own, F.lower("appid") == F.col("_app"), "left").withColumn("jobid", F.coalesce("jobid", "_job")).drop("_app", "_job")
