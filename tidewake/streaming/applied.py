"""Emissions applied once: identities that are forgotten after a time, and device state kept up to date by batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewake.functions.keys import IDENTITY
from tidewake.operators.state import DEVICE, apply_once

TTL_SECONDS = 6 * 3600


BUCKET = "__bucket"
HOUR = 3_600_000


class _Applied(StatefulProcessor):
    """The times at which the identities of a bucket were last applied, until they are ``ttl`` old."""

    def __init__(self, applied_at: str, ttl_seconds: int):
        self.at, self.ttl = applied_at, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "identity string", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        held: dict[str, int | None] = {}
        fresh, taken = {}, []
        identities = map("\x1f".join, zip(*(frame[c].astype(str) for c in IDENTITY), strict=True))
        times = frame[self.at].astype("datetime64[us]").astype("int64")
        for identity, now in zip(identities, times, strict=True):
            if identity not in held:
                held[identity] = self.last.getValue((identity,))[0] if self.last.containsKey((identity,)) else None
            taken.append(held[identity] is None or now - held[identity] >= self.ttl)
            if taken[-1]:
                held[identity] = fresh[identity] = int(now)
        for identity, now in fresh.items():
            self.last.updateValue((identity,), (now,))
        if fresh:  # a timer for each hour in which an identity ends
            for hour in {(now + self.ttl) // 1000 // HOUR for now in fresh.values()}:
                self.handle.registerTimer((hour + 1) * HOUR)
        yield frame[taken].drop(columns=[BUCKET], errors="ignore")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for identity in [k for k, v in self.last.iterator() if v[0] + self.ttl <= end]:
            self.last.removeKey(identity)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def dedupe_emissions(emissions: DataFrame, applied_at: str, ttl_seconds: int = TTL_SECONDS, delay: str = "10 minutes", buckets: int = 64) -> DataFrame:
    """Each identity once in ``ttl_seconds`` of the time ``applied_at``; delivered again later than that, it counts again.

    State is held for ``buckets`` of identities by their hash, so that one busy device spreads over
    tasks; an identity goes within an hour after the time of the stream, ``delay`` behind the newest
    row, has passed its end. Rows older than that are too late, as in any stream with a watermark.
    Needs the RocksDB state store.
    """
    dealt = emissions.withWatermark(applied_at, delay).withColumn(BUCKET, F.pmod(F.xxhash64(*IDENTITY), F.lit(buckets)).cast("int"))
    return dealt.groupBy(BUCKET).transformWithStateInPandas(statefulProcessor=_Applied(applied_at, ttl_seconds), outputStructType=emissions.schema, outputMode="Append", timeMode="EventTime")


class StateTable:
    """Device state kept by micro-batches: each writes the devices that it touched; now and then all are written anew.

    A batch holds emissions, deduplicated over batches (see ``dedupe_emissions``), and, where it has
    the column ``reset``, resets, both with ``arrival``. The state of a batch follows from the batches
    before it, so a retried batch writes the same rows again. After ``compact_every`` batches all
    devices are written as a base, and what is older than the base before is removed.
    """

    def __init__(self, path: str, compact_every: int = 10):
        self.path, self.every = path, compact_every

    def _files(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, spark: SparkSession, kind: str) -> list[int]:
        jvm, root, fs = self._files(spark)
        if not fs.exists(root):
            return []
        names = [str(x.getPath().getName()) for x in fs.listStatus(root)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The state of every device after the newest batch, or after those before ``before``."""
        fits = lambda n: before is None or n < before
        bases = [n for n in self._done(spark, "base") if fits(n)]
        deltas = [n for n in self._done(spark, "delta") if fits(n) and (not bases or n > bases[-1])]
        paths = [f"{self.path}/base={n}" for n in bases[-1:]] + [f"{self.path}/delta={n}" for n in deltas]
        if not paths:
            return None
        rows = spark.read.parquet(*paths)
        rest = [c for c in rows.columns if c not in DEVICE]
        return rows.groupBy(*DEVICE).agg(F.max_by(F.struct(*rest), "turn").alias("x")).select(*DEVICE, "x.*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "reset" not in batch.columns:
            batch = batch.withColumn("reset", F.lit(False))
        held = self.read(spark, batch_id)
        fold_batch(batch, held, batch_id).write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.read(spark, batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
            self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        """Remove what the base before the newest covers; that one stays for readers that have begun."""
        jvm, _, fs = self._files(spark)
        bases = self._done(spark, "base")
        if len(bases) < 2:
            return
        old = [f"base={n}" for n in bases[:-2]] + [f"delta={n}" for n in self._done(spark, "delta") if n <= bases[-2]]
        for name in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def fold_batch(batch: DataFrame, held: DataFrame | None, turn: int) -> DataFrame:
    """The new state of the devices in a batch, from it and the state ``held`` before.

    Counters start again after a device's last reset; its newest window and last seen survive it.
    Percentiles are those of the emission with most events in the newest window, the first of equal
    ones, and 0 until one comes after the reset. A device that was only reset has no state.
    All sums combine before the shuffle, so a busy device is a row for each task.
    """
    last = batch.where("reset").groupBy(*DEVICE).agg(F.max("arrival").alias("__reset"))
    once = apply_once(batch.where("not reset").drop("reset")).join(last, DEVICE, "left")
    after = F.col("__reset").isNull() | (F.col("arrival") > F.col("__reset"))
    kept = lambda c: F.sum(F.when(after, F.col(c)).otherwise(0)).alias(c)
    sample = F.struct(F.col("window_id").alias("at"), F.col("count").alias("sample"), "p95_nanos", "p99_nanos")
    fresh = once.groupBy(*DEVICE).agg(
        kept("count"), kept("error_count"), kept("bytes"), F.max("window_id").alias("last_window_id"), F.max_by("window_end_unix_nanos", "window_id").alias("last_seen_unix_nanos"),
        F.max_by(F.when(after, sample), F.when(after, F.struct("window_id", "count", -F.col("arrival")))).alias("best"),
    )
    both = fresh.join(last, DEVICE, "full_outer")
    best = F.col("best")
    if held is None:
        both = both.where("last_window_id is not null")
        columns = {c: F.col(c) for c in ("count", "error_count", "bytes", "last_window_id", "last_seen_unix_nanos")}
    else:
        old = held.select(*DEVICE, F.struct("count", "error_count", "bytes", "last_window_id", "last_seen_unix_nanos", F.struct(F.col("at"), "sample", "p95_nanos", "p99_nanos").alias("best")).alias("o"))
        both = both.join(old, DEVICE, "left").where("last_window_id is not null or o is not null")
        stays = F.when(F.col("__reset").isNull(), F.col("o"))
        columns = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(stays[c], F.lit(0)) for c in ("count", "error_count", "bytes")}
        newer = F.coalesce(F.col("last_window_id") > F.col("o.last_window_id"), F.col("o").isNull())
        columns |= {c: F.when(newer, F.col(c)).otherwise(F.col(f"o.{c}")) for c in ("last_window_id", "last_seen_unix_nanos")}
        rank = lambda s: F.struct(s["at"], s["sample"])
        old_best = stays["best"]
        # of equal samples the earlier batch's stays
        best = F.when(old_best.isNull() | (F.coalesce(rank(best) > rank(old_best), F.lit(False)) & best.isNotNull()), best).otherwise(old_best)
    out = both.select(*DEVICE, *(v.alias(k) for k, v in columns.items()), best.alias("best"))
    fits = F.col("best.at") == F.col("last_window_id")
    zero = lambda c: F.coalesce(F.when(fits, F.col(f"best.{c}")), F.lit(0)).cast("long").alias(c)
    return out.select(*DEVICE, "count", "error_count", "bytes", zero("p95_nanos"), zero("p99_nanos"), "last_window_id", "last_seen_unix_nanos", zero("sample"), F.col("last_window_id").alias("at"), F.lit(turn).cast("long").alias("turn"))


def live_device_state(log: DataFrame, table: StateTable, checkpoint: str, applied_at: str = "applied_at", ttl_seconds: int = TTL_SECONDS, tick: str | None = None) -> StreamingQuery:
    """A query that keeps ``table`` up to date from a log of emissions and resets (``reset``), both with ``arrival``."""
    once = dedupe_emissions(log.where("not reset"), applied_at, ttl_seconds)
    both = once.unionByName(log.where("reset"))
    writer = both.writeStream.foreachBatch(table).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=tick) if tick else writer.trigger(availableNow=True)).start()


class CurrentTable:
    """The name of the state table that readers use, as a numbered file; the newest counts, and one rename makes it so."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _newest(self) -> int:
        if not self._fs.exists(self._at("")):
            return 0
        names = [str(x.getPath().getName()) for x in self._fs.listStatus(self._at(""))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def name(self) -> str | None:
        newest = self._newest()
        return self.spark.read.text(f"{self.path}/{newest}").first()[0] if newest else None

    def switch(self, name: str) -> None:
        newest, aside = self._newest(), self._at("_next")  # readers look at numbers only
        out = self._fs.create(aside, True)
        out.write(bytearray(name.encode()))
        out.close()
        if not self._fs.rename(aside, self._at(str(newest + 1))):
            raise RuntimeError("the current table has changed meanwhile")


def caught_up(live: StateTable, rebuilt: StateTable, spark: SparkSession) -> bool:
    """Whether both tables hold the same state of every device, whatever batches it came in."""
    states = [t.read(spark) for t in (live, rebuilt)]
    if None in states:
        return states[0] is states[1]
    columns = [c for c in states[0].columns if c != "turn"]
    one, two = (x.select(*columns) for x in states)
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def rebuild(log: DataFrame, live: StateTable, rebuilt: StateTable, checkpoint: str, current: CurrentTable, rounds: int = 10, **options) -> bool:
    """Replay ``log`` from its earliest row into ``rebuilt`` beside the live query, and switch readers to it once it has caught up.

    The replay has a checkpoint of its own, so it goes on where it stopped; each round takes what has
    arrived meanwhile. False if it is still behind after ``rounds``, with readers where they were.
    """
    for _ in range(rounds):
        live_device_state(log, rebuilt, checkpoint, **options).awaitTermination()
        if caught_up(live, rebuilt, log.sparkSession):
            current.switch(rebuilt.path)
            return True
    return False
