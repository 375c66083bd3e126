"""Tumbling-window aggregation of events into emissions, and their order, limits and packing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.keys import IDENTITY, KEY, with_window
from tidewake.functions.sketch import ALPHA, QUANTILE_METHODS, bucket_of, collect_sketch, entries_quantile, exact_quantiles, quantiles

EMISSION = [*IDENTITY, "window_start_unix_nanos", "window_end_unix_nanos", "count", "error_count", "bytes", "p95_nanos", "p99_nanos", "max_nanos"]


@lru_cache
def _cell_columns(alpha: float) -> tuple[Column, list[Column]]:
    """Bucket and sums of a cell; made once, as making them takes longer than a small micro-batch's rows do."""
    latency = F.col("latency_nanos")
    sums = [F.count(F.lit(1)).alias("__n"), F.min(latency).alias("__min"), F.max(latency).alias("__max"), F.count_if("failed").alias("__e"), F.sum("bytes").alias("__b")]
    return bucket_of(latency, alpha).alias("__bucket"), sums


def window_cells(events: DataFrame, size_nanos: int, alpha: float = ALPHA, extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of each key, window and latency bucket; Spark combines them before the shuffle."""
    bucket, sums = _cell_columns(alpha)
    return with_window(events, size_nanos).groupBy(*KEY, *extra, "window_id", bucket).agg(*sums)


def merge_cells(cells: DataFrame) -> DataFrame:
    """Cells of the same key, window and bucket added up."""
    by = [c for c in cells.columns if c not in ("__n", "__min", "__max", "__e", "__b")]
    return cells.groupBy(*by).agg(F.sum("__n").alias("__n"), F.min("__min").alias("__min"), F.max("__max").alias("__max"), F.sum("__e").alias("__e"), F.sum("__b").alias("__b"))


@lru_cache
def _window_columns(alpha: float, keep_sketch: bool, percentiles: bool) -> tuple[list[Column], dict[str, Column]]:
    """Sums over a window's cells, and the percentiles that follow from them; made once."""
    sums = [F.sum("__n").alias("count"), F.sum("__e").alias("error_count"), F.sum("__b").alias("bytes"), F.max("__max").alias("max_nanos")]
    if keep_sketch:
        sums.append(collect_sketch(alpha).alias("sketch"))
    if not percentiles:
        return sums, {}
    entries = F.collect_list(F.when(F.col("__bucket").isNotNull(), F.struct(F.col("__bucket").alias("key"), F.col("__n").alias("value"))))
    sums += [F.sort_array(entries).alias("__cells"), F.coalesce(F.sum(F.when(F.col("__bucket").isNull(), F.col("__n"))), F.lit(0)).alias("__zeros")]
    own = F.col("__cells"), F.col("__zeros"), F.col("count"), F.col("max_nanos")
    return sums, {"p95_nanos": entries_quantile(*own, 0.95, alpha), "p99_nanos": entries_quantile(*own, 0.99, alpha)}


def windows_of_cells(cells: DataFrame, size_nanos: int, alpha: float = ALPHA, extra: tuple[str, ...] = (), keep_sketch: bool = False, percentiles: bool = True) -> DataFrame:
    """One row for each key and window of cells that differ in their buckets."""
    sums, found = _window_columns(alpha, keep_sketch, percentiles)
    out = cells.groupBy(*KEY, *extra, "window_id").agg(*sums)
    if found:
        out = out.withColumns(found).drop("__cells", "__zeros")
    return _bounded(out, size_nanos, extra)


def _bounded(windows: DataFrame, size_nanos: int, extra: tuple[str, ...]) -> DataFrame:
    """Windows with their start and end, and their columns in order."""
    start = F.col("window_id") * size_nanos
    out = windows.withColumns({"window_start_unix_nanos": start, "window_end_unix_nanos": start + size_nanos})
    columns = [c for c in EMISSION if c in out.columns]
    return out.select(*columns, *(c for c in extra if c not in columns), *(["sketch"] if "sketch" in out.columns else []))


def aggregate_windows(events: DataFrame, size_nanos: int, alpha: float = ALPHA, extra: tuple[str, ...] = (), keep_sketch: bool = False, method: str = "ddsketch") -> DataFrame:
    """One row for each key and window: count, errors, bytes, p95, p99 and greatest latency.

    Events are first counted by latency bucket, which Spark combines before the shuffle, so a
    window's rows after it are at most its buckets. alpha 0 means the default.
    """
    alpha = alpha or ALPHA
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    if method not in QUANTILE_METHODS:
        raise ValueError(f"method must be one of {QUANTILE_METHODS}")
    out = windows_of_cells(window_cells(events, size_nanos, alpha, extra), size_nanos, alpha, extra, keep_sketch, method == "ddsketch")
    if method != "ddsketch":
        by, both = [*KEY, *extra, "window_id"], {"p95_nanos": 0.95, "p99_nanos": 0.99}
        numbered = with_window(events, size_nanos)
        own = exact_quantiles(numbered, by, "latency_nanos", both) if method == "exact" else quantiles(numbered, by, "latency_nanos", both, method, alpha)
        out = _bounded(out.join(own, by), size_nanos, extra)
    return out


def number_emissions(windows: DataFrame, seed: int = 0) -> DataFrame:
    """Add a sequence that rises from ``seed`` + 1 within each device in the order of emission."""
    order = Window.partitionBy("user_id", "device_id").orderBy("window_id", "process_id", "pod_id")
    return windows.withColumn("sequence", F.row_number().over(order).cast("long") + seed)


def order_emissions(windows: DataFrame) -> DataFrame:
    """Emission order; retained windows, where marked, first."""
    first = [F.desc("retained")] if "retained" in windows.columns else []
    return windows.orderBy(*first, "window_id", *KEY)


def with_retained(new: DataFrame, retained: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Windows to emit now: those whose publishing failed, unchanged, and the new ones."""
    if published is not None:
        retained = retained.join(published.select(*IDENTITY), IDENTITY, "left_anti")
    return retained.withColumn("retained", F.lit(True)).unionByName(new.withColumn("retained", F.lit(False)))


def key_ceiling(events: DataFrame, most: int, size_nanos: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """Events with ``admitted``: whether their key and window is among the first ``most`` by arrival.

    Keys beyond the ceiling are shed; admitted keys keep counting. 0 means no ceiling. With a
    scope, each of its values has a ceiling of its own; without, the first keys are found by a
    distributed top-k and are at most ``most`` rows.
    """
    if most < 0:
        raise ValueError("the ceiling must not be negative")
    numbered = with_window(events, size_nanos).drop("window_start_unix_nanos", "window_end_unix_nanos")
    if most == 0:
        return numbered.withColumn("admitted", F.lit(True))
    by = [*KEY, "window_id"]
    first = numbered.groupBy(*by).agg(F.min("arrival").alias("first"))
    if scope:
        held = first.withColumn("__r", F.row_number().over(Window.partitionBy(*scope).orderBy("first", *by))).where(F.col("__r") <= most)
    else:
        held = first.orderBy("first", *by).limit(most)
    return numbered.join(held.select(*by, F.lit(True).alias("__held")), by, "left").withColumn("admitted", F.coalesce("__held", F.lit(False))).drop("__held")


def publish_batches(events: DataFrame, most: int) -> DataFrame:
    """Pack each device's events, in order of arrival, into batches of at most ``most``."""
    if most < 1:
        raise ValueError("a batch holds at least one event")
    order = Window.partitionBy("device_id").orderBy("arrival")
    numbered = events.withColumn("batch_no", F.floor((F.row_number().over(order) - 1) / most).cast("long"))
    fields = ["arrival", "user_id", "process_id", "pod_id", "kind", "observed_at_unix_nanos", "latency_nanos", "bytes", "failed"]
    return numbered.groupBy("device_id", "batch_no").agg(F.max("observed_at_unix_nanos").alias("created_at_unix_nanos"), F.array_sort(F.collect_list(F.struct(*fields))).alias("events"))
