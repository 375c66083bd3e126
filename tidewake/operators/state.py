"""Per-device state from emissions: the hot fold, the archive's answer, resets, listings, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.keys import IDENTITY, rfc3339
from tidewake.functions.sketch import sketch_merge, sketch_quantile

DEVICE = ["user_id", "device_id"]


def _arrival(df: DataFrame) -> Column:
    """Order of arrival: a column ``arrival`` where there is one, else sequence, process and pod."""
    return F.struct("arrival") if "arrival" in df.columns else F.struct("sequence", "process_id", "pod_id")


def apply_once(emissions: DataFrame) -> DataFrame:
    """The first arrival of each emission identity; a window may have several emissions, which all count."""
    arrival = _arrival(emissions)
    rest = [c for c in emissions.columns if c not in IDENTITY]
    picked = emissions.groupBy(*IDENTITY).agg(F.min_by(F.struct(*rest), arrival).alias("__x"))
    return picked.select(*IDENTITY, "__x.*")


def _fold(emissions: DataFrame, first_on_ties: bool) -> DataFrame:
    newest = F.struct("window_id", "count")
    # of the newest window's emissions the one with most events: on ties the first arrival, or the highest sequence
    best = F.struct("p95_nanos", "p99_nanos", "window_end_unix_nanos")
    if first_on_ties:
        chosen = F.max_by(best, F.struct("window_id", "count", *(-F.col(c) for c in _order(emissions))))
    else:
        chosen = F.max_by(best, F.struct(newest["window_id"].alias("window_id"), F.col("count"), F.col("sequence"), F.col("process_id"), F.col("pod_id")))
    return emissions.groupBy(*DEVICE).agg(F.sum("count").alias("count"), F.sum("error_count").alias("error_count"), F.sum("bytes").alias("bytes"), F.max("window_id").alias("last_window_id"), F.max("count").alias("__n"), chosen.alias("x"))


def _order(emissions: DataFrame) -> list[str]:
    return ["arrival"] if "arrival" in emissions.columns else ["sequence", "process_id"]


def device_state(emissions: DataFrame) -> DataFrame:
    """Counters, newest window and its percentiles of each device; every identity counts once.

    Percentiles are those of the emission with most events in the newest window, the first to
    arrive on ties. All aggregates combine before the shuffle.
    """
    out = _fold(apply_once(emissions), True)
    return out.select(*DEVICE, "count", "error_count", "bytes", F.col("x.p95_nanos").alias("p95_nanos"), F.col("x.p99_nanos").alias("p99_nanos"), "last_window_id", F.col("x.window_end_unix_nanos").alias("last_seen_unix_nanos"))


def archive_device_state(archive: DataFrame) -> DataFrame:
    """The archive's answer: as the hot fold, but ties go to the highest sequence, and it is stale."""
    out = _fold(archive, False)
    seen = F.col("x.window_end_unix_nanos")
    return out.select(*DEVICE, "count", "error_count", "bytes", F.col("x.p95_nanos").alias("p95_nanos"), F.col("x.p99_nanos").alias("p99_nanos"), "last_window_id", F.when(seen > 0, seen).alias("last_seen_unix_nanos"), F.lit(True).alias("stale"))


def latest_percentiles(archive: DataFrame) -> DataFrame:
    """Percentiles of each device's newest window, of the emission with most events and the highest sequence."""
    out = _fold(archive, False)
    return out.select(*DEVICE, "last_window_id", F.col("x.p95_nanos").alias("p95_nanos"), F.col("x.p99_nanos").alias("p99_nanos"))


def device_state_with_resets(emissions: DataFrame, resets: DataFrame) -> DataFrame:
    """State of a log of emissions and resets, both with ``arrival``.

    Counters start again after a device's last reset; newest window and last seen survive it, and
    percentiles come only from later emissions of the overall newest window, else 0. An identity
    applied before a reset stays applied, so its redelivery adds nothing.
    """
    once = apply_once(emissions)
    last = resets.groupBy(*DEVICE).agg(F.max("arrival").alias("__reset"))
    both = once.join(last, DEVICE, "left")
    newest = both.groupBy(*DEVICE).agg(F.max("window_id").alias("last_window_id"), F.max("window_end_unix_nanos").alias("last_seen_unix_nanos"))
    after = both.where("__reset is null or arrival > __reset")
    sums = after.groupBy(*DEVICE).agg(F.sum("count").alias("count"), F.sum("error_count").alias("error_count"), F.sum("bytes").alias("bytes"), F.max("window_id").alias("__w"), F.max_by(F.struct("p95_nanos", "p99_nanos"), F.struct("window_id", "count", -F.col("arrival"))).alias("x"))
    joined = newest.join(sums, DEVICE, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    fresh = F.col("__w") == F.col("last_window_id")
    return joined.select(*DEVICE, *(zero(F.col(c)).alias(c) for c in ("count", "error_count", "bytes")), zero(F.when(fresh, F.col("x.p95_nanos"))).alias("p95_nanos"), zero(F.when(fresh, F.col("x.p99_nanos"))).alias("p99_nanos"), "last_window_id", "last_seen_unix_nanos")


def user_devices(state: DataFrame) -> DataFrame:
    """Sorted distinct devices of each user."""
    return state.groupBy("user_id").agg(F.sort_array(F.collect_set("device_id")).alias("devices"))


def list_devices(state: DataFrame, limit: int = 500, most: int = 5000) -> DataFrame:
    """Each user's first devices by name, how many are listed, and whether there are more.

    A limit of 0 or less means 500, and none exceeds ``most``: the limit is the feature.
    """
    limit = min(limit if limit > 0 else 500, most)
    ranked = state.select(*DEVICE).distinct().withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("device_id"))).where(F.col("r") <= limit + 1)
    shown = F.sort_array(F.collect_list(F.when(F.col("r") <= limit, F.col("device_id"))))
    return ranked.groupBy("user_id").agg(shown.alias("devices"), F.count_if(F.col("r") <= limit).alias("count"), (F.max("r") > limit).alias("truncated"))


def state_output(state: DataFrame) -> DataFrame:
    """Public form of a state: last seen as text, and whether it is stale."""
    stale = F.coalesce("stale", F.lit(False)) if "stale" in state.columns else F.lit(False)
    return state.select(*DEVICE, "count", "error_count", "bytes", "p95_nanos", "p99_nanos", "last_window_id", rfc3339(F.col("last_seen_unix_nanos")).alias("last_seen"), stale.alias("stale"))


def global_view(*regions: DataFrame) -> DataFrame:
    """Devices over all regions: emissions count once wherever they arrived, and sketches are added up."""
    union = regions[0]
    for r in regions[1:]:
        union = union.unionByName(r)
    once = union.dropDuplicates(IDENTITY)
    sums = once.groupBy(*DEVICE).agg(F.sum("count").alias("count"), F.sum("error_count").alias("error_count"), F.sum("bytes").alias("bytes"), F.max("window_id").alias("last_window_id"))
    merged = sketch_merge(once.select(*DEVICE, "sketch"), DEVICE)
    s = F.col("sketch")
    return sums.join(merged, DEVICE).select(*DEVICE, "count", "error_count", "bytes", "last_window_id", sketch_quantile(s, 0.95).alias("p95_nanos"), sketch_quantile(s, 0.99).alias("p99_nanos"))
