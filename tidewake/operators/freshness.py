"""Freshness of answers, reconciliation of stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.sketch import exact_quantiles


def freshness_report(samples: DataFrame, budget_nanos: int, by: list[str] | None = None) -> DataFrame:
    """Sent, lost, mean, p50, p95, p99 and greatest delay of (sent_nanos, visible_nanos), and the verdict.

    A sample never seen is lost. The mean is cut to whole nanoseconds; without delays all are 0.
    """
    by = by or ["__one"]
    df = samples.withColumn("__one", F.lit(1)) if by == ["__one"] else samples
    delays = df.withColumn("delay", F.col("visible_nanos") - F.col("sent_nanos"))
    sums = delays.groupBy(*by).agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("delay").isNull()).alias("lost"), F.expr("coalesce(sum(delay) div count(delay), 0)").alias("mean_nanos"), F.coalesce(F.max("delay"), F.lit(0)).alias("max_nanos"))
    ranks = exact_quantiles(delays, by, "delay", {"p50_nanos": 0.5, "p95_nanos": 0.95, "p99_nanos": 0.99})
    out = sums.join(ranks, by, "left").fillna(0, ["p50_nanos", "p95_nanos", "p99_nanos"])
    out = out.withColumn("passed", (F.col("lost") == 0) & (F.col("p99_nanos") <= budget_nanos))
    return out.drop("__one")


def reconcile(stages: dict[str, DataFrame], by: list[str], value: str = "n") -> DataFrame:
    """Each key's total in every stage and ``diff``, the spread between the largest and the smallest."""
    totals = [df.groupBy(*by).agg(F.sum(value).alias(name)) for name, df in stages.items()]
    joined = reduce(lambda a, b: a.join(b, by, "full_outer"), totals)
    counts = [F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in stages]
    out = joined.select(*by, *counts)
    return out.withColumn("diff", F.greatest(*stages) - F.least(*stages))
