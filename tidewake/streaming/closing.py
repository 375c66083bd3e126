"""Windows emitted once a clock has passed their end, with the open ones' buckets kept in a table between ticks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewake.functions.sketch import ALPHA
from tidewake.operators.windows import merge_cells, window_cells, windows_of_cells
from tidewake.sources.shared import written
from tidewake.sources.sinks import Sink
from tidewake.streaming.ticks import Outbox

#: The time in nanoseconds since 1970 at a tick, by its number.
Clock = Callable[[int], int]


def with_heartbeat(events: DataFrame) -> DataFrame:
    """The same stream, which also has a micro-batch when nothing has arrived for a second."""
    beats = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    return events.unionByName(beats.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema)))


def close_windows(events: DataFrame, size_nanos: int, sink: Sink, store: Outbox, checkpoint: str, clock: Clock | None = None, alpha: float = ALPHA, tick: str | None = None) -> StreamingQuery:
    """Every trigger emits the windows whose end the clock has passed, as one delta of each, with p95 and p99.

    What is open waits in ``store`` as counts by latency bucket, so it is bounded by the keys of open
    windows, not by events; older ticks' tables are removed. Late events are never dropped: those of a
    window that has left make a further delta at their own tick. A delta's sequence is its tick's
    number; a tick that is repeated starts from what the one before it left, so an identity always has
    the same counts, and a later clock only adds windows. ``clock`` is the wall clock where it is not
    given. With ``tick`` a heartbeat closes windows of streams that have gone quiet; without, the job
    takes all there is, a tick for each micro-batch, and ends.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, time.time_ns() if clock is None else clock(batch_id)
        fresh, held = window_cells(batch, size_nanos, alpha), store.waiting(batch.sparkSession, batch_id)
        cells = written(fresh if held is None else merge_cells(fresh.unionByName(held)), "cells")
        due = (F.col("window_id") + 1) * size_nanos <= now
        closed = cells.where(due).withColumn("sequence", F.lit(batch_id + 1).cast("long"))
        sink(windows_of_cells(closed, size_nanos, alpha, ("sequence",)), batch_id)
        store.commit(cells.where(~due), batch_id)
        store.forget(spark, batch_id - 1)

    stream = with_heartbeat(events) if tick else events
    writer = stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=tick) if tick else writer.trigger(availableNow=True)).start()
