"""Windows that leave once a clock has passed their end: late events, repeated ticks, quiet streams."""

import time

import pytest
from pyspark.errors import StreamingQueryException

from tests.test_telemetry import BASE, EVENT, S, events
from tidewake.operators import windows
from tidewake.sources import sinks
from tidewake.sources.shared import new_path
from tidewake.streaming import closing, ticks

SIZE = 10 * S
FIRST = BASE // SIZE


def arrive(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


def emitted(spark, path):
    return sorted((r["window_id"] - FIRST, r["sequence"], r["count"], r["p95_nanos"]) for r in spark.read.parquet(path).collect())


def plain(spark, rows):
    return windows.aggregate_windows(events(spark, rows), SIZE).collect()[0]["p95_nanos"]


def test_late_events_leave_as_a_further_delta_and_open_windows_wait(spark):
    source, out, store = new_path(spark, "in"), new_path(spark, "out"), ticks.Outbox(new_path(spark, "open"))
    early, more, late = [{"lat": 0}] + [{"lat": 1000 * k} for k in range(1, 10)], [{"t": BASE + 12 * S}] * 3, [{"lat": 9000}] * 2
    for rows in (early + more, late + more, [{"t": BASE + 40 * S}]):
        arrive(spark, source, rows)
    clocks = [(FIRST + k) * SIZE for k in (1, 1, 2)]
    closing.close_windows(stream(spark, source), SIZE, sinks.append_parquet(out), store, new_path(spark, "check"), clocks.__getitem__).awaitTermination()
    assert emitted(spark, out) == [(0, 1, 10, plain(spark, early)), (0, 2, 2, plain(spark, late)), (1, 3, 6, plain(spark, more))]
    left = store.waiting(spark).collect()
    assert [(r["window_id"] - FIRST, r["__n"]) for r in left] == [(4, 1)]
    assert store._committed(spark) == [1, 2]  # a repeated tick 2 needs no earlier one


def test_a_tick_that_fails_between_sink_and_commit_repeats_the_same_deltas(spark, monkeypatch):
    source, out, check, store = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "check"), ticks.Outbox(new_path(spark, "open"))
    arrive(spark, source, [{}] * 4 + [{"t": BASE + 12 * S}] * 3)
    arrive(spark, source, [{}] * 2 + [{"t": BASE + 12 * S}] * 5)
    clocks, commit, seen = [(FIRST + k) * SIZE for k in (1, 2)], ticks.Outbox.commit, []

    def failing(self, left, tick):
        if tick == 1 and not seen:
            seen.append(emitted(spark, out))
            raise RuntimeError("lost")
        commit(self, left, tick)

    monkeypatch.setattr(ticks.Outbox, "commit", failing)
    run = lambda: closing.close_windows(stream(spark, source), SIZE, sinks.append_parquet(out), store, check, clocks.__getitem__).awaitTermination()
    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert [x[:3] for x in emitted(spark, out)] == [(0, 1, 4), (0, 2, 2), (1, 2, 8)] and seen == [emitted(spark, out)]


def test_a_quiet_stream_still_closes(spark):
    source, out, store = new_path(spark, "in"), new_path(spark, "out"), ticks.Outbox(new_path(spark, "open"))
    arrive(spark, source, [{}] * 4)
    now = [BASE]
    query = closing.close_windows(stream(spark, source), SIZE, sinks.append_parquet(out), store, new_path(spark, "check"), lambda tick: now[0], tick="300 milliseconds")
    try:
        for _ in range(120):
            if (held := store.waiting(spark)) is not None and held.count():
                now[0] = BASE + SIZE
            if now[0] > BASE and not held.count():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(w, n) for w, _, n, _ in emitted(spark, out)] == [(0, 4)]
