"""DuckDB SQL for the registered queries. Sketches, k-means and JSON text have none."""

from __future__ import annotations

from ..functions.scopes import SCOPES, pattern, variables
from .queries import APP, JOB, LOG_LINE, METRIC_NAME, PLACE, TM

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
MS = "(epoch_us(ts) // 1000)"
DAY = 86_400_000

_TRAIL = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_EXPLODED = "(SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)"

ORACLES = {
    "groupby_count": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "moving_avg_array": f"""SELECT vec_id, pos, round(avg(value) OVER w, 6) AS avg, count(*) OVER w AS cnt FROM {_EXPLODED}
        WINDOW w AS (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "moving_avg_rows": f"SELECT event_id, user_id, round(avg(value) {_TRAIL}, 6) AS moving_avg, round(sum(value) {_TRAIL}, 4) AS moving_sum, count(value) {_TRAIL} AS moving_count FROM events",
    "moving_avg_global": f"SELECT vec_id, pos, round(avg(value) OVER (ORDER BY vec_id, pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM {_EXPLODED}",
    "moving_avg_verify": "SELECT true AS agrees",
    "array_stats": "SELECT count(vec_id) AS n, avg(len(embedding)) AS avg_size FROM embeddings",
    "shuffle_placement": "SELECT o_orderkey % 8 AS dest, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
    "verify_shuffle": "SELECT 0::BIGINT AS misplaced",
    "shuffle_conservation": "SELECT count(*) AS n_rows, sum(l_orderkey)::BIGINT AS key_sum, max(l_orderkey) AS key_max FROM lineitem",
    "rebalance": "SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS key_sum, max(o_orderkey) AS key_max FROM orders",
    "placement_alternate": "SELECT o_custkey % 7 AS dest, count(*) AS n FROM orders GROUP BY 1",
    "placement_sort": "SELECT o_orderkey, o_orderkey % 8 AS dest, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) - 1 AS pos FROM orders",
    "destinations": "SELECT s_suppkey, s_suppkey % 8 AS dest FROM supplier",
    "key_histogram": "SELECT o_custkey, string_agg(r || ':' || n, ',' ORDER BY r) AS spread FROM (SELECT o_custkey, o_orderkey % 4 AS r, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
    "key_index": "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1",
    "round_robin": "SELECT event_id % 3 AS part, count(*) AS n FROM events GROUP BY 1",
    "salted_count": "SELECT event_type || ':' || (event_id % 100) AS salted_key, count(*) AS n FROM events GROUP BY 1",
    "cogroup_counts": """SELECT key, coalesce(l, 0) AS n_left, coalesce(r, 0) AS n_right
        FROM (SELECT o_orderkey AS key, count(*) AS l FROM orders GROUP BY 1)
        FULL JOIN (SELECT l_orderkey AS key, count(*) AS r FROM lineitem GROUP BY 1) USING (key)""",
    "cogroup_nested": """SELECT key, coalesce(l, '') AS left_rows, coalesce(r, '') AS right_rows
        FROM (SELECT c_nationkey AS key, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS l FROM customer GROUP BY 1)
        FULL JOIN (SELECT s_nationkey AS key, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS r FROM supplier GROUP BY 1) USING (key)""",
    "cogroup_arrow": """SELECT key, coalesce(l, 0) AS n_left, r AS right_max FROM (SELECT c_nationkey AS key, count(*) AS l FROM customer GROUP BY 1)
        FULL JOIN (SELECT s_nationkey AS key, max(s_suppkey) AS r FROM supplier GROUP BY 1) USING (key)""",
    "reduce_by_key": "SELECT l_returnflag, count(*) AS n, max(l_orderkey) AS most FROM lineitem GROUP BY 1",
    "reduce_incremental": "SELECT l_partkey, sum(l_linenumber)::BIGINT AS total, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY 1",
    "counter_fold": f'SELECT event_type, sum(v)::BIGINT AS sum, min(v) AS min, max(v) AS max, count(v) AS count, (sum(v) // count(v))::BIGINT AS avg FROM (SELECT event_type, {K} AS v FROM events) GROUP BY 1',
    "double_counter_fold": "SELECT event_type, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS count, trunc(sum(value) / count(value))::BIGINT AS avg FROM events GROUP BY 1",
    "gauge_fold": "SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS last, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS count, trunc(sum(value) / count(value))::BIGINT AS avg FROM events GROUP BY 1, 2",
    "histogram_fold": "SELECT event_type, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS count, round(avg(value), 4) AS avg, "
    + ", ".join(f"round(quantile_cont(value, {q}), 4) AS {n}" for q, n in ((0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"), (0.9999, "p9999")))
    + " FROM events GROUP BY 1",
    "flatten_metrics": f"""SELECT event_id, 'hits' AS name, 'a=' || event_type || ' env=x' AS tags, 'COUNTER' AS type, 'hits#a=' || event_type || ' env=x#COUNTER' AS key, {K} AS value FROM events
        UNION ALL SELECT event_id, '', '', 'COUNTER', '##COUNTER', {K} + 1 FROM events
        UNION ALL SELECT event_id, 'level', 'b=' || user_id || ' env=x', 'GAUGE', 'level#b=' || user_id || ' env=x#GAUGE', {K} FROM events""",
    "app_from_task_manager": f"SELECT event_id, CASE WHEN event_id % 3 > 0 THEN {APP} END AS app FROM events",
    "json_extract": f"SELECT event_id, {K} AS k FROM events",
    "union_all": "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation",
    "sort_limit": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 5",
    "topk_latest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "column_units": " UNION ALL ".join(
        f"SELECT '{c}' AS column, {e}::BIGINT AS units FROM part" for c, e in (("p_partkey", "1"), ("p_name", "max(length(p_name))"), ("p_brand", "max(length(p_brand))"), ("p_type", "max(length(p_type))"), ("p_size", "1"), ("p_retailprice", "1"))
    ).replace(", 1::BIGINT", ", max(1)::BIGINT").replace("AS column, 1::", "AS column, max(1)::").replace("AS column", 'AS "column"'),
    "row_map_filter": "SELECT l_orderkey, (l_linenumber * 10)::BIGINT AS scaled FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'",
    "batch_function": "SELECT o_orderkey, o_orderkey * 2 AS twice FROM orders WHERE o_orderkey % 2 = 0",
    "matrix_roundtrip": "SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber::DOUBLE AS l_linenumber, l_quantity FROM lineitem",
    "bench_stats": "SELECT event_type AS mode, count(*) AS runs, min(event_id)::DOUBLE AS min_time, round(avg(event_id), 4) AS avg_time, max(user_id)::DOUBLE AS max_rate, round(avg(user_id), 4) AS avg_rate FROM events WHERE event_id % 10 > 0 GROUP BY 1",
    "sample_dump": "SELECT 'r_regionkey, r_name' AS line UNION ALL SELECT 'r_regionkey=' || r_regionkey || ', r_name=' || r_name FROM region",
    "thrift_roundtrip": f"SELECT event_id, {MS} AS timestamp, event_type AS service_name, {K} AS k, event_id AS id, CASE WHEN event_id % 4 > 0 THEN value END AS v, NULL::VARCHAR AS node_tags FROM events",
    "thrift_groupby": f"SELECT event_type AS service_name, count(*) AS n, max({MS}) AS latest FROM events GROUP BY 1",
    "deep_event_summary": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_readings, CASE WHEN event_id % 2 = 0 THEN 'r' || (user_id % 3) ELSE 'n/a' END AS region, (user_id % 7)::INTEGER AS first_metric,
        CASE WHEN user_id = event_id THEN 1 ELSE 2 END::BIGINT AS n_labels, user_id AS second_count, CASE WHEN event_id % 2 = 0 THEN 'NYC' END AS city, CASE WHEN event_id % 3 = 0 THEN 'n1' ELSE 'n2' END AS last_note FROM events""",
    "flatten_struct": "SELECT o_orderkey AS head_id, o_custkey AS head_who_key, o_orderstatus AS head_who_status, o_custkey AS c, o_orderkey AS o FROM orders",
    "ttl_filter": f"SELECT event_id, {MS} AS ms FROM events WHERE {MS} >= (SELECT max({MS}) FROM events) - {DAY}",
    "key_window": f"SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY {MS} DESC, event_id DESC) AS rows FROM events WHERE {MS} >= (SELECT max({MS}) FROM events) - {5 * DAY} GROUP BY 1",
    "cogroup_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "cogroup_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "cogroup_full": "SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey",
    "cogroup_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "cogroup_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}

# -- lines of folded counters -------------------------------------------------------------------------------------

_FOLD = f"(SELECT event_type, user_id, sum(v)::BIGINT AS s, min(v) AS lo, max(v) AS hi, count(v) AS n FROM (SELECT event_type, user_id, {K} AS v FROM events) GROUP BY 1, 2)"
_LINE = "'put {0}' || event_type || '{1} 0 ' || ({2}) || ' user=' || user_id"
_LINES = " UNION ALL ".join(
    f"SELECT event_type, user_id, {_LINE.format(p, s, e)} AS line FROM {_FOLD}"
    for p, s, e in (("mabs.counters.", "", "s"), ("mabs_agg.counters.", ".sum", "s"), ("mabs_agg.counters.", ".max", "hi"), ("mabs_agg.counters.", ".min", "lo"), ("mabs_agg.counters.", ".avg", "s // n"), ("mabs_agg.counters.", ".count", "n"))
)
ORACLES["put_lines"] = f"SELECT * FROM ({_LINES})"
ORACLES["put_batches"] = f"""SELECT event_type, batch, string_agg(line, chr(10) ORDER BY line) AS lines, count(*) AS n
    FROM (SELECT event_type, line, (row_number() OVER (PARTITION BY event_type ORDER BY line) - 1) // 250 AS batch FROM ({_LINES})) GROUP BY 1, 2"""

# -- names and logs -----------------------------------------------------------------------------------------------

_NAMED = f"(SELECT event_id, user_id, {METRIC_NAME} AS metric FROM events)"
_SCOPE = "CASE " + " ".join(f"WHEN regexp_matches(metric, '{pattern(t)}') THEN '{s}'" for s, t in SCOPES.items()) + " ELSE 'UNKNOWN' END"
ORACLES["scope_classify"] = f"SELECT event_id, {_SCOPE} AS scope FROM {_NAMED}"


def _variable(v: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN regexp_extract(metric, '{pattern(t)}', {variables(t).index(v) + 1})" for s, t in SCOPES.items() if v in variables(t))
    return f"CASE scope {cases} END AS {v}"


_TAIL_NAME = "CASE scope " + " ".join(f"WHEN '{s}' THEN regexp_extract(metric, '{pattern(t)}', {len(variables(t)) + 1})" for s, t in SCOPES.items() if len(variables(t)) < 9) + " END AS name"
ORACLES["scope_extract"] = f"SELECT event_id, {', '.join(map(_variable, ('host', 'tm_id', 'job_id', 'job_name', 'application_id', 'subtask_index')))}, {_TAIL_NAME} FROM (SELECT *, {_SCOPE} AS scope FROM {_NAMED})"
ORACLES["scope_extract"] = ORACLES["scope_extract"].replace(" END AS name", " WHEN 'TASK' THEN 'numOut' END AS name")  # more groups than DuckDB extracts

_GOOD = "event_id % 5 < 4"
_HOST = "'xenon-' || CASE WHEN event_id % 2 = 0 THEN 'prod' ELSE 'dev' END || '-' || (user_id % 7)"
ORACLES["log_parse"] = f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown_user' WHEN 1 THEN 'unknown_user' WHEN 2 THEN 'u.' || user_id WHEN 3 THEN 'bob' END AS user,
    CASE WHEN {_GOOD} THEN {_HOST} || '-n' || (event_id % 5) END AS host, CASE WHEN {_GOOD} THEN {APP} END AS application_id, CASE WHEN {_GOOD} THEN {TM} END AS container_id,
    CASE WHEN {_GOOD} THEN epoch_ms(CAST('2024-01-0' || (1 + event_id % 9) || ' 10:00:0' || (event_id % 10) AS TIMESTAMP)) END AS timestamp,
    CASE WHEN {_GOOD} THEN CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'INFO' END END AS level, CASE WHEN {_GOOD} THEN {PLACE} END AS place,
    CASE WHEN {_GOOD} THEN 'failed ' || event_type || chr(10) || 'more' END AS message, CASE WHEN {_GOOD} THEN {_HOST} END AS cluster FROM events"""
ORACLES["cleanup_filter"] = f"""SELECT 'metric' AS type, {APP} AS appid, {JOB} AS jobid, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY ALL
    UNION ALL SELECT 'log', {APP}, NULL, count(*) FROM events WHERE event_id % 3 = 0 AND {_GOOD} GROUP BY ALL"""
assert LOG_LINE

# -- states -------------------------------------------------------------------------------------------------------

_SIGNALS = f"""(SELECT 'app_' || user_id AS app, {MS} AS t, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS cluster, CASE WHEN event_id % 5 = 0 THEN 'job' || (user_id % 50) END AS job_id,
    CASE WHEN event_id % 7 = 0 THEN event_type END AS job_name, CASE WHEN event_id % 2 = 0 THEN 'u' END AS user FROM events)"""
_STATE = "SELECT app, " + ", ".join(f"arg_min({c}, row(t, id)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("cluster", "job_id", "job_name", '"user"')) + f", max(t) AS last_updated FROM {_SIGNALS} GROUP BY 1"
_STATE = _STATE.replace('AS user FROM events', 'AS "user" FROM events')
ORACLES["app_state"] = f"SELECT * FROM ({_STATE}) WHERE last_updated >= (SELECT max({MS}) FROM events) - {3 * DAY}"
ORACLES["log_parse"] = ORACLES["log_parse"].replace("END AS user,", 'END AS "user",')
ORACLES["app_exceptions"] = f"""SELECT user_id AS app, string_agg(event_id::VARCHAR, ',' ORDER BY regular, t, event_id) AS exceptions
    FROM (SELECT user_id, event_id, {MS} AS t, event_id % 4 > 0 AS regular FROM events QUALIFY row_number() OVER (PARTITION BY user_id, regular ORDER BY t DESC, event_id DESC) <= 20) GROUP BY 1"""
_JOBS = f"(SELECT 'job' || (user_id % 50) AS jobid, {MS} AS t, event_id AS id, event_id % 6 AS m, CASE WHEN event_id % 11 > 0 THEN event_id END AS v, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE event_id::VARCHAR END AS txt FROM events)"


def _last(cond: str) -> str:
    return f"arg_max(v, row(t, id)) FILTER (v IS NOT NULL AND {cond})"


_JOB_STATE = f"""SELECT j.*, coalesce(paths, '') AS paths FROM (
    SELECT jobid, {_last("m = 0")} AS uptime, {_last("m IN (1, 2)")} AS restarts, {_last("m = 5")} AS failed_checkpoints, {_last("m = 3")} AS checkpoint_size, NULL::BIGINT AS checkpoint_duration FROM {_JOBS} GROUP BY 1) j
    LEFT JOIN (SELECT jobid, string_agg(txt, ',' ORDER BY t DESC, id DESC) AS paths FROM (SELECT * FROM {_JOBS} WHERE m = 4 QUALIFY row_number() OVER (PARTITION BY jobid ORDER BY t DESC, id DESC) <= 3) GROUP BY 1) USING (jobid)"""
ORACLES["job_state"] = _JOB_STATE
ORACLES["job_info"] = f"SELECT app, job_id, last_updated, uptime, restarts, failed_checkpoints, checkpoint_size, paths FROM ({_STATE}) s LEFT JOIN ({_JOB_STATE}) j ON s.job_id = j.jobid"
ORACLES["fill_job"] = f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE job_id END AS jobid FROM events LEFT JOIN ({_STATE}) s ON s.app = 'app_' || user_id"
