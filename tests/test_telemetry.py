"""Scenarios of the telemetry operators on small tables."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewake.functions import keys, sketch
from tidewake.operators import archive, capture, freshness, rates, state, validate, windows
from tidewake.sources import codec, sinks
from tidewake.sources.shared import new_path
from tidewake.streaming import applied, jobs

EVENT = "device_id string, user_id string, process_id int, pod_id string, kind int, observed_at_unix_nanos long, latency_nanos long, bytes long, failed boolean, arrival long"
S = 1_000_000_000
BASE = 1_700_000_000 * S


def events(spark, rows):
    full = [("device-1", "user-1", r.get("p", 1), "pod-a", r.get("kind", 1), r.get("t", BASE), r.get("lat", 1500), r.get("bytes", 100), r.get("failed", False), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def emission(window, count, p99=None, sequence=1, process=1, arrival=0, device="d", user="u"):
    return (user, device, process, "pod", window, sequence, window * 10, window * 10 + 10, count, count // 10, 100 * count, 1000 * window, 2000 * window if p99 is None else p99, 0, arrival)


EMISSION = codec.WINDOW_SCHEMA + ", arrival long"


def emissions(spark, *rows):
    return spark.createDataFrame(list(rows), EMISSION)


def test_two_processes_two_windows(spark):
    df = events(spark, [{"p": 1}] * 10 + [{"p": 2, "failed": True}] * 5 + [{"p": 1, "t": BASE + 10 * S}])
    got = {(r["process_id"], r["window_id"]): (r["count"], r["error_count"], r["bytes"]) for r in windows.aggregate_windows(df, 10 * S).collect()}
    w = BASE // (10 * S)
    assert got == {(1, w): (10, 0, 1000), (2, w): (5, 5, 500), (1, w + 1): (1, 0, 100)}


def test_percentiles_within_one_percent(spark):
    df = events(spark, [{"lat": 1000 * i} for i in range(1, 1001)])
    r = windows.aggregate_windows(df, 10 * S).first()
    assert abs(r["p95_nanos"] - 950_000) <= 9_500 and abs(r["p99_nanos"] - 990_000) <= 9_900 and r["max_nanos"] == 1_000_000


def test_window_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        windows.aggregate_windows(events(spark, [{}]), 0)


def test_sketch_accuracy(spark):
    rng = random.Random(11)
    values = [rng.randint(1000, 9999) if rng.random() < 0.98 else rng.randint(500_000, 1_000_000) for _ in range(20_000)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v long")
    r = sketch.sketch_error(df, ["g"], "v", {"a": 0.5, "b": 0.9, "c": 0.95, "d": 0.99}).first()
    assert all(r[f"{n}_ok"] for n in "abcd")
    exact = sorted(values)
    assert r["exact_c"] == exact[math.floor(0.95 * (len(values) - 1))]


def test_sketch_zeros_empty_and_extremes(spark):
    q = lambda vs, x: sketch.quantiles(spark.createDataFrame([(1, v) for v in vs], "g int, v long"), ["g"], "v", {"q": x}).first()["q"]
    assert q([0, 0, 1000], 0.5) == 0
    assert q([(1 << 63) - 1], 0.5) > 0
    with pytest.raises(ValueError):
        sketch.sketch_quantile(F.col("x"), float("nan"))


def test_sketch_merge_equals_single_and_rejects_other_alpha(spark):
    df = spark.createDataFrame([(i % 3, 1, i * 37 % 5000) for i in range(600)], "part int, g int, v long")
    parts = sketch.sketch_build(df, ["g", "part"], "v")
    one = sketch.sketch_build(df, ["g"], "v")
    q = lambda d: d.select(sketch.sketch_quantile(F.col("sketch"), 0.9)).first()[0]
    assert q(sketch.sketch_merge(parts, ["g"])) == q(one)
    mixed = parts.unionByName(sketch.sketch_build(df, ["g", "part"], "v", 0.05))
    with pytest.raises(Exception, match="different alpha"):
        sketch.sketch_merge(mixed, ["g"]).collect()


def test_key_ceiling_sheds_later_keys(spark):
    df = events(spark, [{"p": i % 500} for i in range(1000)])
    got = windows.key_ceiling(df, 10, 10 * S)
    assert got.where("admitted").select("process_id").distinct().count() == 10
    assert got.where("admitted").count() == 20 and got.where("not admitted").count() == 980
    assert windows.key_ceiling(df, 0, 10 * S).where("not admitted").count() == 0
    with pytest.raises(ValueError):
        windows.key_ceiling(df, -1, 10 * S)


def one(df):
    return df.first()


def test_state_fold(spark):
    r = one(state.device_state(emissions(spark, emission(1, 100, process=1, arrival=1), emission(1, 50, process=2, arrival=2), emission(2, 25, arrival=3))))
    assert (r["count"], r["bytes"], r["last_window_id"], r["p95_nanos"]) == (175, 17_500, 2, 2000)


def test_state_out_of_order_and_redelivered(spark):
    rows = [emission(5, 10, arrival=1), emission(2, 10, arrival=2)] + [emission(2, 10, arrival=3 + i) for i in range(4)]
    r = one(state.device_state(emissions(spark, *rows)))
    assert (r["count"], r["last_window_id"], r["p95_nanos"]) == (20, 5, 5000)


def test_percentiles_of_the_largest_delta(spark):
    small = emissions(spark, emission(9, 1000, 9_000_000, 1, arrival=1), emission(9, 2, 900_000_000, 2, arrival=2))
    large = emissions(spark, emission(9, 5, 1000, 1, arrival=1), emission(9, 500, 7000, 2, arrival=2))
    tie = emissions(spark, emission(3, 10, 90_000, process=1, arrival=1), emission(3, 10, 1000, process=2, arrival=2))
    assert [one(state.device_state(x))["p99_nanos"] for x in (small, large, tie)] == [9_000_000, 7000, 90_000]


def resets(spark, *arrivals):
    return spark.createDataFrame([("u", "d", a) for a in arrivals], "user_id string, device_id string, arrival long")


def test_resets(spark):
    f = lambda e, *a: one(state.device_state_with_resets(e, resets(spark, *a)))
    r = f(emissions(spark, emission(4, 100, arrival=1)), 2)
    assert (r["count"], r["p99_nanos"], r["last_window_id"]) == (0, 0, 4)
    assert f(emissions(spark, emission(4, 100, arrival=1), emission(5, 30, arrival=3)), 2)["count"] == 30
    r = f(emissions(spark, emission(9, 1000, 1, 1, arrival=1), emission(9, 5, 4000, 2, arrival=3)), 2)
    assert (r["count"], r["p99_nanos"]) == (5, 4000)
    redelivered = emissions(spark, emission(9, 1000, 1, 1, arrival=1), emission(9, 1000, 1, 1, arrival=3))
    assert f(redelivered, 2)["count"] == 0


def test_any_split_and_order_of_emissions_counts_the_same(spark):
    rng = random.Random(3)
    rows = [emission(rng.randint(1, 5), rng.randint(1, 50), sequence=i, arrival=i) for i in range(40)]
    again = rows + rng.sample(rows, 10)
    rng.shuffle(again)
    a, b = one(state.device_state(emissions(spark, *rows))), one(state.device_state(emissions(spark, *again).repartition(3)))
    assert a == b


def test_tenants_stay_apart(spark):
    df = emissions(spark, emission(1, 10, user="user-1"), emission(1, 70, user="user-2"))
    assert {r["user_id"]: r["count"] for r in state.device_state(df).collect()} == {"user-1": 10, "user-2": 70}


@pytest.mark.parametrize("change,reason", [({"device_id": ""}, "empty device"), ({"user_id": ""}, "empty user"), ({"kind": 200}, "unknown kind"), ({"latency_nanos": -1}, "negative latency"), ({"bytes": -1}, "negative bytes"), ({"observed_at_unix_nanos": None}, "zero timestamp"), ({"kind": 0}, None)])
def test_event_reasons(spark, change, reason):
    base = {"device_id": "device-1", "user_id": "user-1", "process_id": 42, "pod_id": "pod-a", "kind": 1, "observed_at_unix_nanos": BASE, "latency_nanos": 1500, "bytes": 256, "failed": False, "arrival": 0}
    df = spark.createDataFrame([tuple((base | change).values())], EVENT)
    assert df.select(validate.event_reason()).first()[0] == reason


def test_archive_is_idempotent_prunes_and_erases(spark):
    path = new_path(spark, "archive")
    day = 86_400 * S
    rows = [(u, d, 1, "pod", i, 1, i * day, i * day + day, 5, 0, 1, 1, 1, 1) for i, (u, d) in enumerate([("u", "d1"), ("u", "d1"), ("u", "d2")])]
    df = spark.createDataFrame(rows, codec.WINDOW_SCHEMA)
    assert archive.write_archive(df, path) == (3, 0)
    assert archive.write_archive(df.unionByName(df), path) == (0, 6)
    assert archive.scan_archive(spark, path, ["19700102"]).count() == 1
    assert archive.erase_device_files(spark, path, "u", "d1") == 2
    assert [r["device_id"] for r in archive.scan_archive(spark, path).collect()] == ["d2"]
    assert archive.erase_device_files(spark, path, "u", "nobody") == 0
    kept, dropped = archive.drop_days_before(archive.scan_archive(spark, path), "19700104")
    assert kept.count() == 0 and dropped.count() == 1


def test_freshness_report(spark):
    ms = 1_000_000
    df = spark.createDataFrame([(0, x * ms) for x in (10, 20, 30, 40, 1000)], "sent_nanos long, visible_nanos long")
    r = freshness.freshness_report(df, 5 * S).first()
    assert (r["p50_nanos"], r["p99_nanos"], r["max_nanos"], r["mean_nanos"], r["passed"]) == (30 * ms, 40 * ms, 1000 * ms, 220 * ms, True)
    lost = df.unionByName(spark.createDataFrame([(0, None)], "sent_nanos long, visible_nanos long"))
    assert not freshness.freshness_report(lost, 5 * S).first()["passed"]


def test_cap_per_second_against_a_loop(spark):
    rng = random.Random(5)
    rows, t = [], 1
    for i in range(400):
        t += rng.randint(0, 400_000_000)
        rows.append((i % 3, t, i))
    got = {r["seq"]: r["kept"] for r in capture.cap_per_second(spark.createDataFrame(rows, "cpu int, ts_ns long, seq long"), "cpu", 2).collect()}
    start, emitted = {}, {}
    for cpu, t, i in rows:
        if cpu not in start or t - start[cpu] >= S:
            start[cpu], emitted[cpu] = t, 0
        assert got[i] == (emitted[cpu] < 2)
        emitted[cpu] += emitted[cpu] < 2


def test_kernel_records(spark):
    import struct

    raw = struct.pack("<QQqIIiB3x", 5, 7, -2, 1, 4_000_000_000, -3, 1)
    df = spark.createDataFrame([(bytearray(raw + b"more"),), (bytearray(raw[:39]),), (None,)], "raw binary")
    got = capture.decode_kernel_records(df).collect()
    assert tuple(got[0])[1:] == (5, 7, -2, 1, 4_000_000_000 - (1 << 32), -3, True, None)
    assert [r["reason"] for r in got[1:]] == ["short record"] * 2


def test_counter_reset_and_rate(spark):
    df = spark.createDataFrame([("m", "s", i * 60, v) for i, v in enumerate([0.0, 60.0, 30.0])], "metric string, series string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert [r["rate"] for r in rates.counter_rate(df, 300).orderBy("ts").collect()] == [0.0, 0.2, 0.3]


def test_alert_needs_its_time(spark):
    wide = spark.createDataFrame([(i * 30, 1.0 if i else 0.0) for i in range(25)], "t long, x double").withColumn("ts", F.timestamp_seconds("t"))
    got = [r["state"] for r in rates.alert_states(wide, [("a", "x > 0", 300)]).orderBy("ts").collect()]
    assert got == ["pending"] * 10 + ["firing"] * 14


def test_fan_out_reaches_later_sinks_and_raises_the_first(spark):
    seen = []

    def bad(name):
        def sink(batch, batch_id):
            raise RuntimeError(name)

        return sink

    write = sinks.fan_out({"a": bad("first"), "b": lambda b, i: seen.append(b.count()), "c": bad("second")})
    with pytest.raises(RuntimeError, match="first"):
        write(spark.range(3), 0)
    assert seen == [3]


@pytest.mark.parametrize(("failures", "kept"), [(2, True), (3, False)])
def test_a_batch_has_three_attempts_before_the_dead_letters(spark, failures, kept):
    source, good, dead = (new_path(spark, x) for x in ("in", "good", "dead"))
    messages = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{"), ("c", None)], "key string, value string")
    messages.coalesce(1).write.parquet(source)
    tries = []

    def handler(batch, batch_id):
        tries.append(batch_id)
        if len(tries) <= failures:
            raise RuntimeError("no luck")
        sinks.append_parquet(good)(batch, batch_id)

    stream = spark.readStream.schema(messages.schema).parquet(source)
    jobs.split_poison(stream, "x long", handler, sinks.append_parquet(dead), "raw", new_path(spark, "check")).awaitTermination()
    reasons = {r["key"]: r["reason"] for r in spark.read.parquet(dead).collect()}
    lost = {"b": "malformed", "c": "malformed"}
    assert len(tries) == 3 and reasons == (lost if kept else lost | {"a": "RuntimeError: no luck"})
    if kept:
        assert [tuple(r) for r in spark.read.parquet(good).select("key", "x").collect()] == [("a", 1)]


def test_state_survives_a_retry(spark):
    s = applied.StateTable(new_path(spark, "states"))
    s(emissions(spark, emission(1, 10, arrival=1)), 0)
    s(emissions(spark, emission(2, 5, arrival=2)), 1)
    s(emissions(spark, emission(2, 5, arrival=2)), 1)
    r = s.read(spark).first()
    assert (r["count"], r["last_window_id"], r["p95_nanos"]) == (15, 2, 2000)


def test_protobuf_is_reached_only_with_its_connector(spark):
    with pytest.raises(ValueError):
        codec.encode_windows(emissions(spark, emission(1, 1)).drop("arrival"), "avro")


def test_metric_names(spark):
    df = spark.createDataFrame([("A.b-c",), ("__",), ("",)], "n string")
    assert [r[0] for r in df.select(keys.metric_export_name(F.col("n"), "x")).collect()] == ["x_a_b_c_total", "x_unnamed_total", "x_unnamed_total"]


def test_closed_windows_leave_once_and_late_events_again(spark):
    """A window whose end has passed is emitted by a timer; events that come later make a second delta."""
    source, out, check = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "check")
    first = events(spark, [{"lat": 0}] + [{}] * 9)
    first.coalesce(1).write.parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        stream = jobs.emit_closed_windows(spark.readStream.schema(EVENT).parquet(source), 10 * S)
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", check).trigger(processingTime="500 milliseconds").start(out)

        def wait(rows):
            for _ in range(120):
                if spark.read.schema(jobs.CLOSED).parquet(out).count() >= rows:
                    return
                time.sleep(0.5)

        wait(1)
        events(spark, [{}] * 4).coalesce(1).write.mode("append").parquet(source)
        wait(2)
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(jobs.CLOSED).parquet(out).withColumn("p50", jobs.closed_quantile(F.col("buckets"), F.col("count"), 0.5)).orderBy("sequence").collect()
    assert [r["count"] for r in got] == [10, 4] and got[0]["sequence"] != got[1]["sequence"]
    assert abs(got[0]["p50"] - 1500) <= 15
