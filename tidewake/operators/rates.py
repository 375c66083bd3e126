"""Counters over time: rates, failure ratios, drain times, alert rules, flood limits, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The counters that are known by name.
KNOWN_COUNTERS = """agent_batches_sent agent_batches_spooled agent_batches_drained agent_spool_dropped agent_batches_refused
agent_spool_release_failed http_ingest_accepted http_ingest_rejected http_ingest_unauthenticated ingest_batches_accepted
ingest_batches_rejected ingest_events_accepted kafka_published kafka_consumed kafka_retried kafka_dead_letter
aggregator_batches_consumed aggregator_windows_emitted aggregator_windows_retained aggregator_events_shed
persister_windows_persisted postgres_windows_persisted postgres_windows_duplicate windows_applied windows_duplicate
events_counted errors_counted device_resets commands_applied commands_rejected watch_updates_dropped
consumer_handler_errors runtime_stage_failures""".split()


def pipeline_metrics(deltas: DataFrame, zero_fill: bool = False) -> DataFrame:
    """(name, value) of each counter; zero deltas make none, and ``zero_fill`` adds the known ones at 0."""
    sums = deltas.where("delta <> 0").groupBy("name").agg(F.sum("delta").alias("value"))
    if not zero_fill:
        return sums
    known = deltas.sparkSession.createDataFrame([(n,) for n in KNOWN_COUNTERS], "name string")
    return sums.join(F.broadcast(known), "name", "full_outer").select("name", F.coalesce("value", F.lit(0)).alias("value"))


def counter_coverage(declared: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, problem): declared but not listed, or listed but never declared."""
    one = declared.select("name").distinct().join(listed, "name", "left_anti").select("name", F.lit("unlisted").alias("problem"))
    two = listed.select("name").distinct().join(declared, "name", "left_anti").select("name", F.lit("never emitted").alias("problem"))
    return one.unionByName(two)


def counter_rate(samples: DataFrame, span_seconds: int, times: DataFrame | None = None) -> DataFrame:
    """(metric, ts, rate): increase a second over the trailing span, summed over series.

    Only samples within the span count, its begin excluded: an increase counts where the sample
    before it is in the span too. A value below the one before it means that the counter began
    again from 0. ``times`` (metric, ts) says when to evaluate, by default at a metric's samples;
    every series counts at every time. Exact for whole-number counters.

    An increase holds from its sample until the one before leaves the span, so rates are running
    sums of a step up and a step down for each, added up over series before they are ordered.
    """
    series = Window.partitionBy("metric", "series").orderBy("ts")
    pairs = samples.select("metric", "ts", "value", F.lag("value").over(series).alias("p"), F.lag("ts").over(series).alias("p_ts")).where("p is not null")
    pairs = pairs.select("metric", "ts", (F.col("p_ts") + F.expr(f"interval {int(span_seconds)} seconds")).alias("gone"), F.when(F.col("value") < F.col("p"), F.col("value")).otherwise(F.col("value") - F.col("p")).alias("up")).where("gone > ts and up > 0")
    steps = pairs.select("metric", F.explode(F.array(F.struct("ts", F.col("up").alias("step")), F.struct(F.col("gone").alias("ts"), (-F.col("up")).alias("step")))).alias("x")).select("metric", "x.*", F.lit(False).alias("asked"))
    asked = (samples if times is None else times).select("metric", "ts", F.lit(0.0).alias("step"), F.lit(True).alias("asked"))
    summed = steps.unionByName(asked).groupBy("metric", "ts").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    so_far = F.sum("step").over(Window.partitionBy("metric").orderBy("ts"))
    return summed.withColumn("rate", so_far / span_seconds).where("asked").select("metric", "ts", "rate")


def rates_wide(samples: DataFrame, spans: dict[str, int], metrics: list[str], step_seconds: int | None = None) -> DataFrame:
    """One row for each time with a column metric_span for each rate, 0 without samples.

    Times are those of any of the metrics' samples, or, with ``step_seconds``, a grid from the first to the last.
    """
    samples = samples.where(F.col("metric").isin(metrics))
    if step_seconds is None:
        times = samples.select("ts").distinct()
    else:
        ends = samples.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a is not null")
        times = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {int(step_seconds)} seconds"))).alias("ts"))
    times = times.select(F.explode(F.array(*map(F.lit, metrics))).alias("metric"), "ts")
    long = None
    for name, seconds in spans.items():
        one = counter_rate(samples, seconds, times).select("ts", F.concat("metric", F.lit(f"_{name}")).alias("m"), "rate")
        long = one if long is None else long.unionByName(one)
    columns = [f"{m}_{s}" for m in metrics for s in spans]
    return long.groupBy("ts").pivot("m", columns).agg(F.first("rate")).fillna(0.0, columns)


def ingest_failure_ratio(samples: DataFrame, span_seconds: int) -> DataFrame:
    """(ts, ratio) of rejected and unauthenticated to all requests, whose rate counts as 1 at least."""
    names = ["http_ingest_accepted", "http_ingest_rejected", "http_ingest_unauthenticated"]
    wide = rates_wide(samples, {"x": span_seconds}, names)
    ok, bad, unknown = (F.col(f"{n}_x") for n in names)
    return wide.select("ts", ((bad + unknown) / F.greatest(ok + bad + unknown, F.lit(1.0))).alias("ratio"))


def drain_time(lag: DataFrame, samples: DataFrame, consumed: str, span_seconds: int) -> DataFrame:
    """(ts, seconds) until a backlog is gone at the rate of consumption, which counts as 1 at least."""
    rate = counter_rate(samples.where(F.col("metric") == consumed), span_seconds)
    return lag.join(rate, "ts").select("ts", (F.col("lag") / F.greatest("rate", F.lit(1.0))).alias("seconds"))


# Rule, predicate over the wide rates, seconds that it must hold.
ALERTS = [
    ("IngestErrorBudgetBurningFast", "failure_ratio_5m > 0.0075", 300),
    ("IngestErrorBudgetBurningSlow", "failure_ratio_5m > 0.001", 3600),
    ("IngestUnauthenticatedSpike", "http_ingest_unauthenticated_5m > 1", 600),
    ("AggregatorConsumerLagBreachingFreshness", "lag / greatest(aggregator_batches_consumed_5m, 1D) > 5", 300),
    ("WindowEmissionStalled", "aggregator_batches_consumed_10m > 0 and aggregator_windows_emitted_10m = 0", 600),
    ("WindowsRetainedAfterFailedEmit", "aggregator_windows_retained_10m > 0", 900),
    ("AggregationSheddingKeys", "aggregator_events_shed_10m > 0", 900),
    ("HotStateWritesStopped", "aggregator_windows_emitted_10m > 0 and windows_applied_10m = 0", 600),
    ("DeadLetterRateNonZero", "kafka_dead_letter_15m > 0", 900),
    ("RuntimeStageFailing", "runtime_stage_failures_10m > 0", 600),
    ("AgentSpoolingToDisk", "agent_batches_spooled_10m > 0", 600),
    ("AgentSpoolDroppingBatches", "agent_spool_dropped_10m > 0", 300),
    ("WatchUpdatesDropped", "watch_updates_dropped_10m > 0", 900),
    ("PostgresArchiveFallingBehindRedis", "windows_applied_15m - postgres_windows_persisted_15m > 0.1 * windows_applied_15m", 1800),
]
ALERT_METRICS = ["http_ingest_accepted", "http_ingest_rejected", "http_ingest_unauthenticated", "aggregator_batches_consumed", "aggregator_windows_emitted", "aggregator_windows_retained", "aggregator_events_shed", "windows_applied", "kafka_dead_letter", "runtime_stage_failures", "agent_batches_spooled", "agent_spool_dropped", "watch_updates_dropped", "postgres_windows_persisted"]
SPANS = {"5m": 300, "10m": 600, "15m": 900}


def alert_states(wide: DataFrame, rules: list[tuple[str, str, int]] = ALERTS) -> DataFrame:
    """(rule, ts, state) where a rule's predicate holds: firing once it has held for its time, else pending.

    ``wide`` has a row for each evaluation, with the rates and the lag. Times stay in their rule's
    partition; runs are found by counting the evaluations at which the predicate changed.
    """
    marks = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.expr(p), F.lit(False)).alias("on"), F.lit(s).alias("hold")) for n, p, s in rules))
    long = wide.select("ts", F.explode(marks).alias("x")).select("ts", "x.*")
    order = Window.partitionBy("rule").orderBy("ts")
    runs = long.withColumn("__new", (F.col("on") != F.coalesce(F.lag("on").over(order), F.lit(False))).cast("int")).withColumn("__run", F.sum("__new").over(order)).where("on")
    since = F.min("ts").over(Window.partitionBy("rule", "__run"))
    held = F.col("ts").cast("long") - since.cast("long")
    return runs.withColumn("state", F.when(held >= F.col("hold"), "firing").otherwise("pending")).select("rule", "ts", "state")


def as_of(times: DataFrame, gauge: DataFrame, value: str, seconds: int = 300) -> DataFrame:
    """``times`` (ts) with ``value``: of each series of ``gauge`` its last sample in the ``seconds`` up to the time, summed; null without any.

    Series are told apart by a column ``series`` where there is one. Times and samples meet by
    stretches of ``seconds``, so neither is ordered as a whole.
    """
    stretch = lambda c: F.floor(c.cast("double") / seconds).cast("long")
    series = F.col("series") if "series" in gauge.columns else F.lit("")
    samples = gauge.select(F.col("ts").alias("__at"), F.col(value).alias("__v"), series.alias("__s"))
    samples = samples.withColumn("__k", F.explode(F.array(stretch(F.col("__at")), stretch(F.col("__at")) + 1)))
    near = times.select("ts", stretch(F.col("ts")).alias("__k")).join(samples, "__k")
    near = near.where((F.col("__at") <= F.col("ts")) & (F.col("__at") > F.col("ts") - F.expr(f"interval {int(seconds)} seconds")))
    found = near.groupBy("ts", "__s").agg(F.max_by("__v", "__at").alias("v")).groupBy("ts").agg(F.sum("v").alias(value))
    return times.join(found, "ts", "left")


def alerts(samples: DataFrame, lag: DataFrame, rules: list[tuple[str, str, int]] = ALERTS, spans: dict[str, int] = SPANS, step_seconds: int | None = 30) -> DataFrame:
    """States of the alert rules every ``step_seconds``, or at the samples' times if none are given.

    ``lag`` (ts, lag, and series if there are several) is a gauge: its last sample within five minutes counts, else 0.
    """
    wide = rates_wide(samples, spans, ALERT_METRICS, step_seconds)
    ok, bad, unknown = (F.col(f"http_ingest_{n}_5m") for n in ("accepted", "rejected", "unauthenticated"))
    wide = wide.withColumn("failure_ratio_5m", (bad + unknown) / F.greatest(ok + bad + unknown, F.lit(1.0)))
    return alert_states(as_of(wide, lag, "lag").fillna(0.0, ["lag"]), rules)


def flood_report(requests: DataFrame, limit: int = 600, span_seconds: int = 10, at: str = "ts_unix") -> DataFrame:
    """Requests with how many their device made in the trailing span, and whether that is too many."""
    span = Window.partitionBy("device_id").orderBy(at).rangeBetween(-span_seconds, 0)
    return requests.withColumn("in_span", F.count(F.lit(1)).over(span)).withColumn("denied", F.col("in_span") > limit)


def batch_stats(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """What became of each sender's events and batches."""
    n = lambda c, v: F.sum(F.when(F.col("outcome") == v, F.col(c)).otherwise(0)).cast("long")
    one = lambda v: F.count_if(F.col("outcome") == v)
    return outcomes.groupBy(*by).agg(n("events", "sent").alias("events_accepted"), n("events", "rejected").alias("events_rejected"), n("events", "dropped").alias("events_dropped"), F.count_if(F.col("outcome") != "dropped").alias("batches_enqueued"), one("dropped").alias("batches_dropped"), one("sent").alias("batches_sent"), one("rejected").alias("failures"))




def trim_backlog(backlog: DataFrame, max_bytes: int) -> DataFrame:
    """Entries with ``kept``: the oldest go until a device's sizes fit the budget and its count the cap."""
    cap = max(64, max_bytes // 1024)
    newest = Window.partitionBy("device_id").orderBy(F.desc("ordinal"), F.desc("sequence"))
    sizes = F.sum("size_bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return backlog.withColumn("kept", (sizes <= max_bytes) & (F.row_number().over(newest) <= cap))
