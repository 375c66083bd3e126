"""Telemetry, emissions, requests and the like, derived from the given tables.

The SQL of each is written once for Spark and DuckDB; only a few functions differ.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.keys import DAY_NANOS
from tidewake.operators.windows import aggregate_windows
from tidewake.sources.shared import written

SIZE = DAY_NANOS
G = 1.01 / 0.99
LN_G = repr(math.log(G))


def _num(expr: str, prefix: str) -> str:
    return f"'{prefix}-' || lpad(CAST({expr} AS STRING), 3, '0')"


def telemetry_sql(duck: bool) -> str:
    micros = "epoch_us(ts)" if duck else "unix_micros(CAST(ts AS TIMESTAMP))"
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)" if duck else "CAST(get_json_object(props, '$.k') AS BIGINT)"
    return f"""SELECT {_num('user_id % 20', 'device')} AS device_id, {_num('(user_id % 20) % 8', 'user')} AS user_id,
  CAST(100 + event_id % 4 AS INT) AS process_id, {_num('(user_id % 20) % 8', 'pod')} AS pod_id,
  CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 1 END AS INT) AS kind,
  {micros} * 1000 AS observed_at_unix_nanos, CAST(round(value * 1000000) AS BIGINT) AS latency_nanos,
  64 + {k} AS bytes, event_type = 'error' AS failed, event_id AS arrival, {k} AS k, event_type FROM {'events' if duck else '{events}'}"""


def invalid_sql(duck: bool, source: str) -> str:
    return f"""SELECT CASE WHEN arrival % 113 = 0 THEN '' ELSE device_id END AS device_id, CASE WHEN arrival % 97 = 0 THEN '' ELSE user_id END AS user_id,
  process_id, pod_id, CASE WHEN arrival % 101 = 0 THEN 9 ELSE kind END AS kind,
  CASE WHEN arrival % 109 = 0 THEN NULL ELSE observed_at_unix_nanos END AS observed_at_unix_nanos,
  CASE WHEN arrival % 103 = 0 THEN -1 ELSE latency_nanos END AS latency_nanos, CASE WHEN arrival % 107 = 0 THEN -1 ELSE bytes END AS bytes, failed, arrival
  FROM {source}"""


def requests_sql(duck: bool) -> str:
    c = "customer" if duck else "{customer}"
    return f"""SELECT c_custkey AS request_id, 'p-' || lpad(CAST(c_custkey % 12 AS STRING), 3, '0') AS principal,
  CASE WHEN c_custkey % 53 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN {_num('c_custkey % 12', 'user')} ELSE {_num('(c_custkey % 23) % 8', 'user')} END AS user_id,
  CASE WHEN c_custkey % 41 = 0 THEN repeat('x', 300) WHEN c_custkey % 43 = 0 THEN '' WHEN c_custkey % 47 = 0 THEN 'bad' || chr(7) ELSE {_num('c_custkey % 23', 'device')} END AS device_id,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'someone-' || CAST(c_custkey % 7 AS STRING) END AS claimed_actor FROM {c}"""


def commands_sql(duck: bool) -> str:
    c = "customer" if duck else "{customer}"
    return f"""SELECT c_custkey AS command_id, CAST(CASE WHEN c_custkey % 11 = 0 THEN 2 WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END AS INT) AS kind,
  CASE WHEN c_custkey % 19 = 0 THEN '' ELSE {_num('(c_custkey % 23) % 8', 'user')} END AS user_id,
  CASE WHEN c_custkey % 29 = 0 THEN '' ELSE {_num('c_custkey % 23', 'device')} END AS device_id,
  CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'user-001' END AS actor FROM {c}"""


def principals_sql(duck: bool) -> str:
    n = "nation" if duck else "{nation}"
    none, admin = ("CAST([] AS VARCHAR[])", "['read', 'admin']") if duck else ("CAST(array() AS array<string>)", "array('read', 'admin')")
    return f"""SELECT 'p-' || lpad(CAST(n_nationkey AS STRING), 3, '0') AS principal, {_num('n_nationkey % 9', 'user')} AS user_id,
  CASE WHEN n_nationkey = 9 THEN {admin} ELSE {none} END AS scopes FROM {n} WHERE n_nationkey IN (0, 1, 2, 3, 4, 5, 6, 7, 9)"""


def trace_sql(duck: bool, source: str) -> str:
    base = f"""SELECT (k % 40) * 4 + process_id % 4 AS pid_tgid, k % 40 AS tgid, observed_at_unix_nanos AS ts_ns, latency_nanos, CASE WHEN failed THEN -1 - k WHEN k % 7 = 0 THEN -5000 ELSE k END AS ret,
  CAST(k AS INT) AS syscall_nr, arrival, CAST(arrival % 8 AS INT) AS cpu FROM {source}"""
    enter = f"SELECT cpu, pid_tgid, tgid, 'enter' AS side, ts_ns, CAST(0 AS BIGINT) AS ret, syscall_nr, arrival * 4 AS seq FROM ({base}) WHERE arrival % 13 <> 0"
    twice = f"SELECT cpu, pid_tgid, tgid, 'enter' AS side, ts_ns + 10 AS ts_ns, CAST(0 AS BIGINT) AS ret, syscall_nr, arrival * 4 + 1 AS seq FROM ({base}) WHERE arrival % 17 = 0"
    leave = f"SELECT cpu, pid_tgid, tgid, 'exit' AS side, ts_ns + latency_nanos AS ts_ns, ret, syscall_nr, arrival * 4 + 2 AS seq FROM ({base})"
    return f"{enter} UNION ALL {twice} UNION ALL {leave}"


def samples_sql(duck: bool) -> str:
    e = "events" if duck else "{events}"
    ts = "ts" if duck else "CAST(ts AS TIMESTAMP)"
    return f"""SELECT metric, series, ts, CAST(sum(n) OVER (PARTITION BY metric, series, date_trunc('day', ts) ORDER BY ts) AS DOUBLE) AS value FROM (
  SELECT CASE event_type WHEN 'click' THEN 'http_ingest_accepted' WHEN 'error' THEN 'http_ingest_rejected' WHEN 'view' THEN 'aggregator_batches_consumed' WHEN 'purchase' THEN 'aggregator_windows_emitted' ELSE 'windows_applied' END AS metric,
    's' || CAST(user_id % 3 AS STRING) AS series, date_trunc('hour', {ts}) AS ts, count(*) AS n FROM {e} GROUP BY 1, 2, 3)"""


def fast_samples_sql(duck: bool) -> str:
    """Counters of all alert rules every 30 seconds: an hour of the events becomes half a minute; two of them pause."""
    e = "events" if duck else "{events}"
    ts = "ts" if duck else "CAST(ts AS TIMESTAMP)"
    slot = f"date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', {ts})" if duck else f"CAST((unix_timestamp({ts}) - unix_timestamp(TIMESTAMP '2024-01-01 00:00:00')) DIV 3600 AS BIGINT)"
    at = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(slot * 30)" if duck else "timestamp_seconds(unix_timestamp(TIMESTAMP '2024-01-01 00:00:00') + slot * 30)"
    return f"""SELECT metric, series, {at} AS ts, CAST(100 * sum(n) OVER (PARTITION BY metric, series, CAST(floor(slot / 24) AS BIGINT) ORDER BY slot) AS DOUBLE) AS value FROM (
  SELECT CASE event_type
    WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'http_ingest_unauthenticated' WHEN 1 THEN 'aggregator_events_shed' ELSE 'http_ingest_accepted' END
    WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'kafka_dead_letter' WHEN 1 THEN 'runtime_stage_failures' ELSE 'http_ingest_rejected' END
    WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'agent_batches_spooled' WHEN 1 THEN 'agent_spool_dropped' ELSE 'aggregator_batches_consumed' END
    WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'watch_updates_dropped' ELSE 'aggregator_windows_emitted' END
    ELSE CASE event_id % 4 WHEN 0 THEN 'postgres_windows_persisted' WHEN 1 THEN 'aggregator_windows_retained' ELSE 'windows_applied' END END AS metric,
    's' || CAST(user_id % 3 AS STRING) AS series, slot, count(*) AS n FROM (SELECT *, {slot} AS slot FROM {e}) GROUP BY 1, 2, 3)
  WHERE NOT (metric = 'aggregator_windows_emitted' AND slot BETWEEN 200 AND 300) AND NOT (metric = 'windows_applied' AND slot BETWEEN 400 AND 500)"""


def freshness_sql(duck: bool, source: str) -> str:
    return f"SELECT device_id, arrival AS round, observed_at_unix_nanos AS sent_nanos, CASE WHEN k % 50 = 0 THEN NULL ELSE observed_at_unix_nanos + latency_nanos END AS visible_nanos FROM {source}"


def backlog_sql(duck: bool) -> str:
    o = "orders" if duck else "{orders}"
    return f"SELECT {_num('o_custkey % 20', 'device')} AS device_id, o_orderkey AS ordinal, o_orderkey AS sequence, CAST(round(o_totalprice) AS BIGINT) AS size_bytes FROM {o}"


def outcomes_sql(duck: bool) -> str:
    o = "orders" if duck else "{orders}"
    return f"SELECT {_num('o_custkey % 20', 'device')} AS device_id, o_orderkey AS batch_id, CASE WHEN o_orderkey % 10 = 0 THEN 'rejected' WHEN o_orderkey % 7 = 0 THEN 'dropped' ELSE 'sent' END AS outcome, 1 + o_custkey % 25 AS events FROM {o}"


def feed_sql(duck: bool) -> str:
    """Telemetry from order lines: the larger feed."""
    source = "lineitem" if duck else "{lineitem}"
    micros = "epoch_us(l_shipdate)" if duck else "unix_micros(CAST(l_shipdate AS TIMESTAMP))"
    return f"""SELECT {_num('l_suppkey % 20', 'device')} AS device_id, {_num('(l_suppkey % 20) % 8', 'user')} AS user_id, CAST(l_linenumber AS INT) AS process_id, {_num('(l_suppkey % 20) % 8', 'pod')} AS pod_id,
  CAST(1 AS INT) AS kind, {micros} * 1000 AS observed_at_unix_nanos, CAST(round(l_extendedprice * 1000) AS BIGINT) AS latency_nanos, CAST(l_quantity AS BIGINT) AS bytes, l_returnflag = 'R' AS failed FROM {source}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, telemetry_sql(False), "events")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, feed_sql(False), "lineitem")


def invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(invalid_sql(False, "{t}"), t=telemetry(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, requests_sql(False), "customer")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, commands_sql(False), "customer")


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, principals_sql(False), "nation")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(trace_sql(False, "{t}"), t=telemetry(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, samples_sql(False), "events")


def fast_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, fast_samples_sql(False), "events")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(freshness_sql(False, "{t}"), t=telemetry(spark, sf_dir))


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, backlog_sql(False), "orders")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, outcomes_sql(False), "orders")


def emissions(spark: SparkSession, sf_dir: str, keep_sketch: bool = False) -> DataFrame:
    """Three interleaved deltas of every window, as late data makes them."""
    events = telemetry(spark, sf_dir).withColumn("sequence", F.col("arrival") % 3 + 1)
    return aggregate_windows(events, SIZE, extra=("sequence",), keep_sketch=keep_sketch)


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = emissions(spark, sf_dir)
    return one.unionByName(one.where("window_id % 5 = 0"))


def log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(emissions with arrival, some redelivered later; resets with arrival)."""
    arrival = F.col("window_id") * 10_000 + F.col("sequence") * 1_000 + F.col("process_id")
    one = written(emissions(spark, sf_dir).withColumn("arrival", arrival), "emissions")  # so that events are aggregated once
    again = one.where("window_id % 5 = 0").withColumn("arrival", F.col("arrival") + 150_000)
    resets = one.select("user_id", "device_id").distinct().where("CAST(right(device_id, 3) AS INT) % 3 = 0").withColumn("arrival", F.lit(19_740 * 10_000 + 1_999).cast("long"))
    return one.unionByName(again), resets


def duck_windows(source: str, extra: str = "", size: int = SIZE) -> str:
    """DuckDB's form of the window aggregate over ``source``."""
    key = "user_id, device_id, process_id, pod_id, window_id" + (f", {extra}" if extra else "")

    def quantile(q: str) -> str:
        at = f"min(bk) FILTER (cum > floor(CAST({q} AS DOUBLE) * (tot - 1)))"
        return f"CASE WHEN {at} = -2147483648 THEN 0 ELSE CAST(round(2 * pow(CAST({G!r} AS DOUBLE), {at}) / (1 + CAST({G!r} AS DOUBLE))) AS BIGINT) END"

    return f"""SELECT {key}, window_id * {size} AS window_start_unix_nanos, (window_id + 1) * {size} AS window_end_unix_nanos,
  CAST(sum(n) AS BIGINT) AS count, CAST(sum(e) AS BIGINT) AS error_count, CAST(sum(b) AS BIGINT) AS bytes,
  {quantile('0.95')} AS p95_nanos, {quantile('0.99')} AS p99_nanos, max(m) AS max_nanos
FROM (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY bk) AS cum, sum(n) OVER (PARTITION BY {key}) AS tot FROM (
  SELECT {key}, CASE WHEN latency_nanos > 0 THEN CAST(ceil(ln(latency_nanos) / CAST({LN_G} AS DOUBLE)) AS INTEGER) ELSE -2147483648 END AS bk,
    count(*) AS n, count_if(failed) AS e, sum(bytes) AS b, max(latency_nanos) AS m
  FROM (SELECT *, observed_at_unix_nanos // {size} AS window_id FROM {source}) GROUP BY ALL)) GROUP BY {key}"""


def duck_with(*names: str) -> str:
    """A WITH clause that defines the named fixtures for DuckDB."""
    parts = {
        "telemetry": telemetry_sql(True),
        "feed": feed_sql(True),
        "invalid": invalid_sql(True, "telemetry"),
        "requests": requests_sql(True),
        "commands": commands_sql(True),
        "principals": principals_sql(True),
        "trace": trace_sql(True, "telemetry"),
        "samples": samples_sql(True),
        "fast_samples": fast_samples_sql(True),
        "freshness": freshness_sql(True, "telemetry"),
        "backlog": backlog_sql(True),
        "outcomes": outcomes_sql(True),
        "emissions": duck_windows("(SELECT *, arrival % 3 + 1 AS sequence FROM telemetry)", "sequence"),
        "log": "SELECT *, window_id * 10000 + sequence * 1000 + process_id AS arrival FROM emissions",
        "resets": "SELECT DISTINCT user_id, device_id, CAST(197401999 AS BIGINT) AS arrival FROM emissions WHERE CAST(right(device_id, 3) AS INT) % 3 = 0",
        "state": """SELECT s.*, p.p95_nanos, p.p99_nanos, p.window_end_unix_nanos AS last_seen_unix_nanos FROM (
  SELECT user_id, device_id, CAST(sum(count) AS BIGINT) AS count, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(bytes) AS BIGINT) AS bytes, max(window_id) AS last_window_id FROM emissions GROUP BY ALL) s
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, device_id ORDER BY window_id DESC, count DESC, sequence, process_id) AS r FROM emissions) p
  ON p.r = 1 AND s.user_id = p.user_id AND s.device_id = p.device_id""",
    }
    return "WITH " + ",\n".join(f"{n} AS ({parts[n]})" for n in names) + "\n"
