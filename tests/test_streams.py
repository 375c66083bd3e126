"""Retries by message, identities with a time to live, ceilings and outboxes over ticks, caps, gauges, archive files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_telemetry import EVENT, S, emission, emissions, events
from tidewake.operators import capture, rates, state
from tidewake.operators.archive_files import ArchiveFiles
from tidewake.plans import catalog
from tidewake.plans import fixtures as fx
from tidewake.sources import sinks
from tidewake.sources.codec import WINDOW_SCHEMA
from tidewake.sources.shared import new_path
from tidewake.streaming import applied, jobs, ticks


def refusing(bad, path, calls, luck=lambda n: False):
    """A sink that fails for batches with a row of ``bad``, or when ``luck`` says so, and else writes them."""

    def sink(batch, batch_id):
        held = {r["x"] for r in batch.select("x").collect()}
        calls.append(held)
        if luck(len(calls)) or held & bad:
            raise RuntimeError(f"refused {sorted(held & bad)[:1]}")
        sinks.append_parquet(path)(batch, batch_id)

    return sink


def test_only_the_failing_messages_of_a_batch_are_given_up(spark):
    rows = spark.range(1000).select(F.col("id").alias("n"), (F.col("id") * 10).alias("x")).cache()
    path, calls = new_path(spark, "good"), []
    bad = jobs.deliver(rows, 1000, "n", refusing({170, 8000}, path, calls), 4)
    assert bad == {17: "RuntimeError: refused [170]", 800: "RuntimeError: refused [8000]"}
    kept = [r["x"] for r in spark.read.parquet(path).collect()]
    assert sorted(kept) == [10 * k for k in range(1000) if k not in (17, 800)]
    assert calls.count({170}) == calls.count({8000}) == 3 and len(calls) < 60
    assert calls[-1] == set(kept)


def test_many_refused_messages_take_no_more_calls_of_the_sink(spark):
    source, good, dead = (new_path(spark, x) for x in ("in", "good", "dead"))
    messages = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") == 5, "{").otherwise(F.to_json(F.struct(F.col("id").alias("x")))).alias("value"))
    messages.coalesce(1).write.parquet(source)
    calls, tries = [], new_path(spark, "tries").removeprefix("file:")
    os.makedirs(tries)

    def handler(message):
        if message["x"] % 10 == 3:
            with open(f"{tries}/{message['key']}", "a") as f:
                f.write("x")
            raise ValueError(f"refused {message['x']}")

    def sink(batch, batch_id):
        calls.append(batch_id)
        sinks.append_parquet(good)(batch, batch_id)

    stream = spark.readStream.schema(messages.schema).parquet(source)
    jobs.split_poison(stream, "x long", sink, sinks.append_parquet(dead), "raw", new_path(spark, "check"), handle=handler).awaitTermination()
    assert calls == [0]
    assert sorted(r["x"] for r in spark.read.parquet(good).collect()) == [k for k in range(3000) if k % 10 != 3 and k != 5]
    lost = {r["key"]: r["reason"] for r in spark.read.parquet(dead).collect()}
    assert lost == {f"k{k}": f"ValueError: refused {k}" for k in range(3, 3000, 10)} | {"k5": "malformed"}
    assert {open(f"{tries}/{name}").read() for name in os.listdir(tries)} == {"xxx"} and len(os.listdir(tries)) == 300


def test_retries_do_not_call_the_sink_for_each_bad_message(spark, monkeypatch):
    calls, append = [], sinks.append_parquet
    monkeypatch.setattr(sinks, "append_parquet", lambda path: lambda batch, batch_id: (calls.append(path), append(path)(batch, batch_id)))
    rows = catalog.QUERIES["str_8_retries"](spark, "/root/testdata/sf0.01")
    assert len(calls) == 4 and rows.count() == 10_000 and rows.where("dead").count() == 2


def test_a_sink_without_luck_loses_no_message(spark):
    rows = spark.range(20).select(F.col("id").alias("n"), F.col("id").alias("x")).cache()
    path, calls = new_path(spark, "good"), []
    assert jobs.deliver(rows, 20, "n", refusing(set(), path, calls, lambda n: n <= 2), 0) == {}
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == list(range(20)) and calls[-1] == set(range(20))
    with pytest.raises(RuntimeError):  # parts pass, the whole does not
        jobs.deliver(rows, 20, "n", _too_large(5), 0)
    with pytest.raises(RuntimeError):  # everything fails: the sink is at fault
        jobs.deliver(rows, 20, "n", refusing(set(range(20)), path, []), 0, most_refused=3)
    assert jobs.deliver(rows.where("false"), 0, "n", refusing({1}, path, calls), 0) == {}


def _too_large(most):
    def sink(batch, batch_id):
        if batch.count() > most:
            raise RuntimeError("too large")

    return sink


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, jobs.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_identities_are_forgotten_after_their_time(spark, rocksdb):
    """Six batches an hour or more apart: a repeat within the time counts no more, a later one does, and state stays level."""
    path, out = new_path(spark, "in"), new_path(spark, "out")
    hours = [0, 1, 3, 7, 8, 15, 22, 29]
    schema = None
    for batch, hour in enumerate(hours):
        fresh = [emission(k, 1, process=batch, arrival=hour) for k in range(40)]
        again = [emission(k, 1, process=0, arrival=hour) for k in range(10)]
        df = emissions(spark, *fresh, *(again if batch else [])).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("arrival") * 3600))
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = applied.dedupe_emissions(stream, "at", 6 * 3600).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "check")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = spark.read.schema(schema).parquet(out).where("process_id = 0 and window_id < 10").groupBy("arrival").count().collect()
    # applied at 0; 1 and 3 repeat; 7 counts; 8 repeats; 15, 22 and 29 count
    assert {r["arrival"]: r["count"] for r in got} == {h: 10 for h in (0, 7, 15, 22, 29)}
    assert spark.read.schema(schema).parquet(out).where("process_id > 0").count() == 40 * 7
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert max(held) < 320 and held[-1] <= 150  # values of 50 to 90 identities and timers of buckets; 320 identities came


def test_state_table_equals_the_fold_of_the_whole_log(spark):
    rng = random.Random(12)
    log, resets = [], []
    for arrival in range(1, 160):
        device = f"d{rng.randint(0, 4)}"
        if rng.random() < 0.12:
            resets.append(("u", device, arrival))
        else:
            log.append(emission(rng.randint(1, 6), rng.randint(1, 9), sequence=arrival, arrival=arrival, device=device))
    resets.append(("u", "reset only", 50))
    every = emissions(spark, *log)
    asked = spark.createDataFrame(resets, "user_id string, device_id string, arrival long")
    both = every.withColumn("reset", F.lit(False)).unionByName(asked.withColumn("reset", F.lit(True)), allowMissingColumns=True).cache()
    table = applied.StateTable(new_path(spark, "state"), compact_every=3)
    bounds = [0, 20, 21, 60, 61, 90, 120, 125, 160]
    for batch, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = both.where(F.col("arrival").between(low + 1, high))
        table(part, batch)
        if batch % 2:
            table(part, batch)  # a retry
    columns = ["user_id", "device_id", "count", "error_count", "bytes", "p95_nanos", "p99_nanos", "last_window_id", "last_seen_unix_nanos"]
    want = state.device_state_with_resets(every, asked).select(*columns)
    got = table.read(spark).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert table._done(spark, "base") == [2, 5] and table._done(spark, "delta") == [3, 4, 5, 6, 7]


def test_failed_windows_come_first_and_unchanged_at_the_next_tick(spark):
    outbox, seen = ticks.Outbox(new_path(spark, "outbox")), {}

    def publish(fails):
        def run(out, tick):
            rows = out.collect()
            seen.setdefault(tick, []).append([(r["window_id"], r["retained"], r["count"]) for r in rows])
            return out.where(~F.col("window_id").isin(fails))

        return run

    new = lambda *windows: emissions(spark, *(emission(w, 10 * w) for w in windows)).drop("arrival")
    ticks.publish_with_outbox(new(5, 2, 3), outbox, publish([3, 5]), 0)
    ticks.publish_with_outbox(new(1, 4), outbox, publish([5]), 1)
    ticks.publish_with_outbox(new(1, 4), outbox, publish([5]), 1)  # repeated: sees the same
    ticks.publish_with_outbox(new(), outbox, publish([]), 2)
    assert seen[0] == [[(2, False, 20), (3, False, 30), (5, False, 50)]]
    assert seen[1] == [[(3, True, 30), (5, True, 50), (1, False, 10), (4, False, 40)]] * 2
    assert seen[2] == [[(5, True, 50)]] and outbox.waiting(spark).count() == 0
    assert [r["window_id"] for r in outbox.waiting(spark, before=1).orderBy("window_id").collect()] == [3, 5]


def test_windows_that_wait_take_room(spark):
    df = events(spark, [{"p": p} for p in (1, 2, 3, 1, 4)])
    held = emissions(spark, emission(1, 1)).withColumn("pod_id", F.lit("pod-a"))
    kept = lambda most, held: sorted({r["process_id"] for r in ticks.admit(df, 10 * S, most, ["pod_id"], held).where("admitted").collect()})
    assert (kept(3, None), kept(3, held), kept(1, held), kept(0, held)) == ([1, 2, 3], [1, 2], [], [1, 2, 3, 4])
    with pytest.raises(ValueError):
        ticks.admit(df, 10 * S, -1, ["pod_id"])
    assert set(df.columns) < set(ticks.admit(df, 10 * S, 2, ["pod_id"]).columns) and EVENT


@pytest.mark.parametrize("cell", [1, 3, 60])
def test_cap_with_pointers_against_a_loop(spark, cell):
    rng = random.Random(cell)
    rows, t = [], 5
    for i in range(1500):
        t += rng.choice([0, 0, 1000, 30_000_000, 300_000_000, 999_999_999, 1_000_000_000, 9_000_000_000] if i % 300 > 250 else [0, 90_000_000, 200_000_000])
        rows.append((rng.choice([0, 0, 0, 1]), t, i, "mine"))
    rows += [(None, 7, 5000, "mine"), (2, None, 5001, "mine"), (3, 9, 5002, "mine")]
    df = spark.createDataFrame(rows, "cpu int, ts_ns long, seq long, start string").repartition(5)
    got = {r["seq"]: r["kept"] for r in capture.cap_per_second(df, "cpu", 3, cell_seconds=cell).collect()}
    start, emitted = {}, {}
    for cpu, t, i, _ in rows:
        if cpu is None or t is None:
            assert got[i]
            continue
        if cpu not in start or t - start[cpu] >= S:
            start[cpu], emitted[cpu] = t, 0
        assert got[i] == (emitted[cpu] < 3), i
        emitted[cpu] += emitted[cpu] < 3
    assert len(got) == len(rows) and not all(got.values())
    assert capture.cap_per_second(df.where("false"), "cpu", 3).count() == 0


def test_gauge_as_of(spark):
    rng = random.Random(8)
    times = sorted(rng.sample(range(4000), 60))
    gauge = [(rng.randint(0, 3000), rng.random(), s) for s in ("a", "b") for _ in range(15)]
    gauge = list({(t, s): (t, v, s) for t, v, s in gauge}.values())
    at = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = rates.as_of(at([(t,) for t in times], "t long"), at(gauge, "t long, lag double, series string"), "lag")
    for r in got.select(F.unix_timestamp("ts").alias("t"), "lag").collect():
        near = [max(((t, v) for t, v, s in gauge if s == name and r["t"] - 300 < t <= r["t"]), default=None) for name in ("a", "b")]
        near = [x[1] for x in near if x]
        assert r["lag"] == (pytest.approx(sum(near)) if near else None)


def day_rows(spark, *rows):
    day = 86_400 * S
    full = [(u, d, 1, "pod", w, 1, w * day, w * day + day, 5, 0, 1, 1, 1, 1) for u, d, w in rows]
    return spark.createDataFrame(full, WINDOW_SCHEMA)


def held(files):
    rows = files.read()
    return [] if rows is None else sorted((r["device_id"], r["window_id"], r["window_day"]) for r in rows.collect())


ROWS = [("u", "d1", 0), ("u", "d1", 1), ("u", "d2", 1), ("u", "d2", 2), ("u", "d1", 3)]


def test_archive_files(spark):
    files = ArchiveFiles(spark, new_path(spark, "archive"))
    assert files.read() is None and files.refile() == files.erase_device("u", "d") == files.drop_days_before("2") == 0
    assert files.append(day_rows(spark, *ROWS)) == (5, 0)
    assert files.append(day_rows(spark, *ROWS, *ROWS, ("u", "d3", 1))) == (1, 10)
    assert files.append(day_rows(spark, ("u", "d4", 2), ("u", "d2", 1)), day="19700109") == (2, 0)
    assert ("d4", 2, "19700109") in held(files)
    assert files.refile() == 2 and files.days() == ["19700101", "19700102", "19700103", "19700104"]
    assert [r for r in held(files) if r[0] == "d4"] == [("d4", 2, "19700103")] and len(held(files)) == 7
    assert files.erase_device("u", "d1") == 3 and files.erase_device("u", "nobody") == 0
    assert files.drop_days_before("19700103") == 1 and files.days() == ["19700103"]
    assert held(files) == [("d2", 2, "19700103"), ("d4", 2, "19700103")]
    assert files.read(["19700101"]) is None and files.vacuum() == 0


CHANGES = {
    "append": lambda f, spark: f.append(day_rows(spark, ("u", "d9", 1), ("u", "d9", 7))),
    "refile": lambda f, spark: f.refile(),
    "erase": lambda f, spark: f.erase_device("u", "d1"),
    "drop": lambda f, spark: f.drop_days_before("19700103"),
}


@pytest.mark.parametrize("change", CHANGES)
def test_a_failure_between_steps_leaves_the_old_or_the_new_archive(spark, change):
    """Whatever step fails, the archive is as before or as after the change, and doing it again completes it."""

    def prepared():
        files = ArchiveFiles(spark, new_path(spark, "archive"))
        files.append(day_rows(spark, *ROWS))
        files.append(day_rows(spark, ("u", "d5", 3)), day="19700101")
        return files

    files, steps = prepared(), []
    old = held(files)
    files.step = steps.append
    CHANGES[change](files, spark)
    new = held(files)
    assert old != new and "switched" in steps
    for k in range(len(steps)):
        files, seen = prepared(), []

        def fail(name, seen=seen, k=k):
            seen.append(name)
            if len(seen) == k + 1:
                raise RuntimeError("lost")

        files.step = fail
        with pytest.raises(RuntimeError, match="lost"):
            CHANGES[change](files, spark)
        again = ArchiveFiles(spark, files.path)
        assert held(again) == (new if "switched" in seen else old)
        CHANGES[change](again, spark)
        assert held(again) == new
        again.vacuum()
        assert held(again) == new


def test_of_two_changes_at_once_the_later_fails(spark):
    files = ArchiveFiles(spark, new_path(spark, "archive"))
    files.append(day_rows(spark, *ROWS))
    other = ArchiveFiles(spark, files.path)
    files.step = lambda name: name == "data written" and other.append(day_rows(spark, ("u", "d8", 2)))
    with pytest.raises(RuntimeError, match="meanwhile"):
        files.erase_device("u", "d1")
    assert len(held(files)) == 6


def test_the_log_aggregates_events_once(spark):
    events, resets = fx.log(spark, "/root/testdata/sf0.001")
    plan = events.unionByName(resets, allowMissingColumns=True)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan
    assert events.count() > 0 and resets.count() > 0
