"""Window emission tick by tick with memory between ticks: windows whose publishing failed, and ceilings that count them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewake.functions.keys import IDENTITY, KEY, with_window
from tidewake.operators.windows import aggregate_windows, order_emissions, with_retained
from tidewake.sources.shared import written

#: Takes windows in emission order and the tick's number; returns those that were published, by identity at least.
Publisher = Callable[[DataFrame, int], DataFrame]


class Outbox:
    """Windows that wait for another try, in a folder for each tick; its success file is the tick's commit record.

    A tick that is repeated reads what the tick before it left, and writes its own folder again.
    """

    def __init__(self, path: str):
        self.path = path

    def _committed(self, spark: SparkSession) -> list[int]:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [str(x.getPath().getName()) for x in fs.listStatus(root)]
        return sorted(int(n.removeprefix("tick=")) for n in names if n.startswith("tick=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def waiting(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """What the newest committed tick (before ``before``) left unpublished; None if there is no such tick."""
        ticks = [n for n in self._committed(spark) if before is None or n < before]
        return spark.read.parquet(f"{self.path}/tick={ticks[-1]}") if ticks else None

    def commit(self, left: DataFrame, tick: int) -> None:
        left.write.mode("overwrite").parquet(f"{self.path}/tick={tick}")

    def forget(self, spark: SparkSession, before: int) -> None:
        """Remove what ticks before ``before`` left; a tick needs no more than the one before it."""
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for n in self._committed(spark):
            if n < before:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/tick={n}"), True)


def publish_with_outbox(new: DataFrame, outbox: Outbox, publish: Publisher, tick: int) -> None:
    """Publish what waits, unchanged and first, and the new windows; what fails waits for the next tick, and holds up no other."""
    held = outbox.waiting(new.sparkSession, tick)
    out = with_retained(new, new.limit(0) if held is None else held)
    out = written(out, "outgoing")
    published = publish(order_emissions(out), tick)
    left = out.join(published.select(*IDENTITY).distinct(), IDENTITY, "left_anti").drop("retained")
    outbox.commit(left, tick)


def admit(events: DataFrame, size_nanos: int, most: int, scope: list[str], held: DataFrame | None = None) -> DataFrame:
    """Events with ``admitted``: whether their key and window is among those that their process has room for.

    Each value of ``scope`` is a process with a ceiling of ``most`` windows, those of ``held``, which
    wait to be published, included; the first to arrive are admitted. 0 means no ceiling. Ranks beyond
    ``most`` are cut off before the shuffle, so a process gathers few rows from each task.
    """
    if most < 0:
        raise ValueError("the ceiling must not be negative")
    numbered = with_window(events, size_nanos).drop("window_start_unix_nanos", "window_end_unix_nanos")
    if most == 0:
        return numbered.withColumn("admitted", F.lit(True))
    by = [*KEY, "window_id"]
    first = numbered.groupBy(*by, *(c for c in scope if c not in by)).agg(F.min("arrival").alias("__first"))
    ranked = first.withColumn("__r", F.row_number().over(Window.partitionBy(*scope).orderBy("__first", *by))).where(F.col("__r") <= most)
    if held is not None:
        ranked = ranked.join(held.groupBy(*scope).agg(F.count(F.lit(1)).alias("__held")), scope, "left").where(F.col("__r") + F.coalesce("__held", F.lit(0)) <= most)
    return numbered.join(ranked.select(*by, F.lit(True).alias("__in")), by, "left").withColumn("admitted", F.coalesce("__in", F.lit(False))).drop("__in")


def emit_ticks(events: DataFrame, size_nanos: int, outbox: Outbox, publish: Publisher, checkpoint: str, most: int = 0, scope: list[str] | None = None, shed: Callable[[DataFrame, int], None] | None = None, tick: str | None = None) -> StreamingQuery:
    """Every trigger emits the windows of its events, and again those whose publishing failed.

    ``most`` and ``scope`` limit how many windows a process holds, open ones and those that wait (see
    ``admit``); a window that has been published makes room in the next tick. Events of windows that
    found no room go to ``shed``. A tick's windows depend on its events, its number and the outbox.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        held = outbox.waiting(batch.sparkSession, batch_id)
        marked = written(admit(batch, size_nanos, most, scope or ["pod_id"], held), "admitted")
        if shed is not None:
            shed(marked.where("not admitted").drop("admitted", "window_id"), batch_id)
        kept = marked.where("admitted").drop("admitted", "window_id").withColumn("sequence", F.lit(batch_id + 1).cast("long"))
        publish_with_outbox(aggregate_windows(kept, size_nanos, extra=("sequence",)), outbox, publish, batch_id)

    writer = events.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=tick) if tick else writer.trigger(availableNow=True)).start()
