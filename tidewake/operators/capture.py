"""System-call traces: decoding, pairing of enters and exits, filters, rate caps, capture counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.keys import classify_failed
from tidewake.sources.shared import written

RECORD_BYTES = 40
SECOND = 1_000_000_000


def _number(raw: str, at: int, size: int) -> Column:
    """Little-endian bytes as a signed 64-bit number."""
    hexed = F.concat(*(F.hex(F.expr(f"substring({raw}, {at + i + 1}, 1)")) for i in range(size - 1, -1, -1)))
    return F.conv(hexed, 16, -10).cast("long")


def _signed32(value: Column) -> Column:
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def decode_kernel_records(df: DataFrame, column: str = "raw") -> DataFrame:
    """The fields of 40-byte little-endian records; ``reason`` marks shorter ones, further bytes are ignored."""
    long_enough = F.octet_length(F.col(column)) >= RECORD_BYTES
    fields = {
        "timestamp_nanos": _number(column, 0, 8),
        "latency_nanos": _number(column, 8, 8),
        "ret": _number(column, 16, 8),
        "pid": _signed32(_number(column, 24, 4)),
        "tgid": _signed32(_number(column, 28, 4)),
        "syscall_nr": _signed32(_number(column, 32, 4)),
        "failed": _number(column, 36, 1) != 0,
    }
    out = df.withColumns({name: F.when(long_enough, value) for name, value in fields.items()})
    return out.withColumn("reason", F.when(F.coalesce(long_enough, F.lit(False)), F.lit(None).cast("string")).otherwise("short record"))


def event_from_kernel(df: DataFrame, device: Column, user: Column, pod: Column, boot_unix_nanos: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of decoded records; without identity or boot time a row is rejected with a reason."""
    reason = F.when(F.coalesce(device, F.lit("")) == "", "no device").when(F.coalesce(user, F.lit("")) == "", "no user").when(F.coalesce(boot_unix_nanos, F.lit(0)) <= 0, "no boot time")
    return df.select(
        *keep,
        device.alias("device_id"),
        user.alias("user_id"),
        F.col("tgid").alias("process_id"),
        pod.alias("pod_id"),
        F.lit(1).alias("kind"),
        (boot_unix_nanos + F.col("timestamp_nanos")).alias("observed_at_unix_nanos"),
        "latency_nanos",
        F.lit(0).cast("long").alias("bytes"),
        "failed",
        reason.alias("reason"),
    )


def pair_syscalls(trace: DataFrame) -> DataFrame:
    """Exits with ``latency_nanos`` since the latest enter of their thread that no exit has used, else unpaired."""
    order = Window.partitionBy("pid_tgid").orderBy("ts_ns", "seq")
    both = trace.withColumns({"__side": F.lag("side").over(order), "__ts": F.lag("ts_ns").over(order)})
    paired = F.col("__side") == "enter"
    exits = both.where("side = 'exit'").withColumn("latency_nanos", F.when(paired, F.col("ts_ns") - F.col("__ts")))
    return exits.withColumns({"paired": F.coalesce(paired, F.lit(False)), "failed": classify_failed(F.col("ret"))}).drop("__side", "__ts")


def capture_filter(trace: DataFrame, enabled: bool = True, target_tgid: int = 0, modulus: int = 0) -> DataFrame:
    """Trace rows with ``kept``: enters of the sampled processes; exits always pass, to be paired or not."""
    if not enabled:
        return trace.withColumn("kept", F.lit(False))
    keep = F.lit(True)
    if target_tgid:
        keep = keep & (F.col("tgid") == target_tgid)
    if modulus > 1:
        keep = keep & (F.col("tgid") % modulus == 0)
    return trace.withColumn("kept", (F.col("side") == "exit") | keep)


def filtered_pairs(trace: DataFrame, min_latency: int = 0, per_second: int = 0, **config) -> DataFrame:
    """Exits paired after the filter, with their ``outcome``: unpaired, filtered, rate_limited or emitted.

    ``per_second`` caps the exits of each CPU that are slow enough; 0 means no cap.
    """
    pairs = pair_syscalls(capture_filter(trace, **config).where("kept").drop("kept"))
    marked = pairs.withColumn("outcome", F.when(~F.col("paired"), "unpaired").when(F.col("latency_nanos") < min_latency, "filtered"))
    if per_second <= 0:
        return marked.withColumn("outcome", F.coalesce("outcome", F.lit("emitted")))
    marked = written(marked, "pairs")
    capped = cap_per_second(marked.where("outcome is null"), "cpu", per_second)
    return marked.where("outcome is not null").unionByName(capped.withColumn("outcome", F.when(F.col("kept"), "emitted").otherwise("rate_limited")).drop("kept"))


def capture_stats(trace: DataFrame, min_latency: int = 0, per_second: int = 0, records: DataFrame | None = None, **config) -> DataFrame:
    """(stat, count) over all CPUs: paired exits observed, what became of them, unpaired exits, and records too short to decode.

    ``records`` holds decoded records with their ``reason``; without it no decoding has failed.
    """
    outcomes = ["emitted", "filtered", "rate_limited", "unpaired"]
    pairs = filtered_pairs(trace, min_latency, per_second, **config)
    sums = pairs.agg(F.count_if("paired").alias("observed"), *(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))
    failures = F.count_if(F.col("reason").isNotNull()).alias("decode_failures")
    long = sums.unpivot([], ["observed", *outcomes], "stat", "count")
    if records is None:
        return long.unionByName(trace.sparkSession.createDataFrame([("decode_failures", 0)], "stat string, count long"))
    return long.unionByName(records.agg(failures).unpivot([], ["decode_failures"], "stat", "count"))


def _next_times(cells: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """(k, t, next): of each time the first one of its key a second or more later; none for the last."""
    asked = cells.select("k", F.col("t").alias("origin"), (F.col("t") + SECOND).alias("p"), F.expr(f"(t + {SECOND}) div {cell}").alias("cell"))
    line = Window.partitionBy("k", "cell").orderBy(F.desc("p"), F.col("origin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = cells.select("k", F.lit(None).cast("long").alias("origin"), F.col("t").alias("p"), "cell").unionByName(asked)
    found = both.withColumn("found", F.last(F.when(F.col("origin").isNull(), F.col("p")), ignorenulls=True).over(line)).where("origin is not null")
    own = edges.select("k", "cell", F.col("after").alias("own_after"), F.lit(True).alias("has"))
    earlier = edges.select("k", (F.col("cell") + 1).alias("cell"), F.col("after").alias("earlier_after"))
    # where the cell that is asked about is empty, the time stands in the one before
    out = found.join(own, ["k", "cell"], "left").join(earlier, ["k", "cell"], "left")
    return out.select("k", F.col("origin").alias("t"), F.when(F.col("has"), F.coalesce("found", "own_after")).otherwise(F.col("earlier_after")).alias("next"))


def _window_starts(times: DataFrame, cell: int) -> DataFrame:
    """(k, t): the times at which windows start. ``times``: distinct (k, t).

    A time a second or more after the one before it starts a window, whatever came before; so keys
    fall into stretches, and in one a start follows from the last by a pointer. Those pointers are
    followed by doubling: round by round every known start reaches the one twice as far ahead.
    """
    cells = times.withColumn("cell", F.expr(f"t div {cell}"))
    along = Window.partitionBy("k").orderBy("cell")  # a row for each cell of a key
    edges = cells.groupBy("k", "cell").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    edges = written(edges.withColumns({"before": F.lag("hi").over(along), "after": F.lead("lo").over(along)}), "cells")
    inside = Window.partitionBy("k", "cell").orderBy("t")
    before = F.coalesce(F.lag("t").over(inside), F.col("before"))
    known = written(cells.join(edges, ["k", "cell"]).withColumn("gap", F.coalesce(F.col("t") - before >= SECOND, F.lit(True))).where("gap").select("k", "t"), "starts")
    jumps = _next_times(cells, edges, cell).where("next is not null")
    jumps = written(jumps.join(known.withColumnRenamed("t", "next"), ["k", "next"], "left_anti").select("k", "t", "next"), "jumps")
    while not jumps.isEmpty():
        known = written(known.unionByName(known.join(jumps, ["k", "t"]).select("k", F.col("next").alias("t"))), "starts")
        onward = jumps.select("k", F.col("t").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(onward, ["k", "next"]).select("k", "t", F.col("far").alias("next")), "jumps")
    return known


def cap_per_second(df: DataFrame, key: str, limit: int, at: str = "ts_ns", cell_seconds: int = 60) -> DataFrame:
    """Rows with ``kept``: at most ``limit`` in each window of a key, which starts at a row and lasts a second.

    A window starts anew with the first row a second or more after its start, so it depends on all
    before it (see ``_window_starts``). Rows are dealt by key and stretches of ``cell_seconds``, so a
    busy key spreads over tasks. Rows of one time stand by ``seq`` where there is one. 0 means no
    limit; rows without key or time belong to no window and are kept.
    """
    if limit <= 0:
        return df.withColumn("kept", F.lit(True))
    cell = cell_seconds * SECOND
    tie = F.col("seq") if "seq" in df.columns else F.lit(0)
    rows = written(df.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(at).cast("long").alias("t"), tie.alias("tie")), "capped")
    timed = rows.where("k is not null and t is not null")
    starts = _window_starts(timed.select("k", "t").distinct(), cell)
    marked = timed.join(starts.withColumn("start", F.col("t")), ["k", "t"], "left").withColumn("cell", F.expr(f"t div {cell}"))
    marked = written(marked.withColumn("start", F.max("start").over(Window.partitionBy("k", "cell").orderBy("t"))), "started")
    earlier = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("k", "cell").agg(F.max("start").alias("last")).select("k", "cell", F.max("last").over(earlier).alias("carried"))
    windows = marked.join(carried, ["k", "cell"]).withColumn("start", F.coalesce("start", "carried"))
    number = F.row_number().over(Window.partitionBy("k", "start").orderBy("t", "tie"))
    out = windows.select("row", (number <= limit).alias("kept"))
    return out.unionByName(rows.where("k is null or t is null").select("row", F.lit(True).alias("kept"))).select("row.*", "kept")
