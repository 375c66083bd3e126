"""Structured Streaming jobs: window emission, change feed, poison handling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewake.functions.keys import KEY, with_window
from tidewake.functions.sketch import ALPHA, bucket_of, value_of
from tidewake.operators.windows import aggregate_windows
from tidewake.sources.shared import numbered, written
from tidewake.sources.sinks import Sink

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def emit_open_windows(events: DataFrame, size_nanos: int, sink: Sink, checkpoint: str, tick: str | None = None) -> StreamingQuery:
    """Every trigger emits one delta for each key and window with events since the last trigger.

    Late events make a further delta of their window, which readers add. A batch's emissions
    depend on its rows and number alone, so a retry emits the same identities. Without ``tick``
    the job takes all there is and ends.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        windows = aggregate_windows(batch.withColumn("sequence", F.lit(batch_id + 1).cast("long")), size_nanos, extra=("sequence",))
        sink(windows, batch_id)

    writer = events.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=tick) if tick else writer.trigger(availableNow=True)).start()


def flush(events: DataFrame, size_nanos: int) -> DataFrame:
    """Everything that is left, at the end of the input, as one delta for each key and window."""
    return aggregate_windows(events.withColumn("sequence", F.lit(1).cast("long")), size_nanos, extra=("sequence",))


CLOSED = "user_id string, device_id string, process_id int, pod_id string, window_id long, sequence long, count long, error_count long, bytes long, max_nanos long, buckets map<int, long>"


class _ClosedWindows(StatefulProcessor):
    """Buckets of a key's window until the clock passes its end; later events make a further delta."""

    def __init__(self, size_nanos: int):
        self.size = size_nanos

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "count long, errors long, bytes long, most long")
        self.cells = handle.getMapState("cells", "bucket int", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.totals.get() if self.totals.exists() else None
        count, errors, size, most = held or (0, 0, 0, 0)
        for frame in rows:
            for bucket, n in frame.groupby("bucket")["n"].sum().items():
                seen = self.cells.getValue((int(bucket),))[0] if self.cells.containsKey((int(bucket),)) else 0
                self.cells.updateValue((int(bucket),), (seen + int(n),))
            count, errors, size, most = count + int(frame["n"].sum()), errors + int(frame["e"].sum()), size + int(frame["b"].sum()), max(most, int(frame["m"].max()))
        self.totals.update((count, errors, size, most))
        if held is None:
            now = timerValues.getCurrentProcessingTimeInMs()
            end = (int(key[4]) + 1) * self.size // 1_000_000
            self.handle.registerTimer(max(end, now) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, errors, size, most = self.totals.get()
        buckets = {int(k[0]): int(v[0]) for k, v in self.cells.iterator()}
        self.totals.clear()
        self.cells.clear()
        yield pd.DataFrame({"user_id": [key[0]], "device_id": [key[1]], "process_id": [key[2]], "pod_id": [key[3]], "window_id": [key[4]], "sequence": [timerValues.getCurrentProcessingTimeInMs()], "count": [count], "error_count": [errors], "bytes": [size], "max_nanos": [most], "buckets": [buckets]})

    def close(self) -> None:
        pass


ZERO_BUCKET = -(1 << 31)


def emit_closed_windows(events: DataFrame, size_nanos: int, alpha: float = ALPHA) -> DataFrame:
    """A stream with one delta of each key's window once the clock has passed it.

    Events of a window that was emitted open it again and leave as a further delta; there is no
    watermark, so none is dropped. Buckets instead of events are kept as state.
    """
    numbered = with_window(events, size_nanos)
    rows = numbered.select(*KEY, "window_id", F.coalesce(bucket_of(F.col("latency_nanos"), alpha), F.lit(ZERO_BUCKET)).alias("bucket"), F.lit(1).cast("long").alias("n"), F.col("failed").cast("long").alias("e"), F.col("bytes").alias("b"), F.col("latency_nanos").alias("m"))
    return rows.groupBy(*KEY, "window_id").transformWithStateInPandas(statefulProcessor=_ClosedWindows(size_nanos), outputStructType=CLOSED, outputMode="Append", timeMode="ProcessingTime")


def closed_quantile(buckets, count, q: float, alpha: float = ALPHA):
    """Quantile of an emitted window's buckets, zeros included."""
    rank = F.floor(F.lit(q) * (count - 1))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("at"))
    step = lambda a, e: F.struct((a["upto"] + e["value"]).alias("upto"), F.when(a["at"].isNull() & (a["upto"] + e["value"] > rank), e["key"]).otherwise(a["at"]).alias("at"))
    at = F.aggregate(F.array_sort(F.map_entries(buckets)), start, step)["at"]
    return F.when(at == ZERO_BUCKET, F.lit(0).cast("long")).otherwise(value_of(at, alpha))


STATE = "user_id string, device_id string, count long, error_count long, bytes long, p95_nanos long, p99_nanos long, last_window_id long, last_seen_unix_nanos long, arrival long"


class _LiveState(StatefulProcessor):
    """State of one device: emissions add, identities count once, resets start again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "count long, errors long, bytes long, p95 long, p99 long, sample long, window long, seen long")
        self.applied = handle.getMapState("applied", "identity string", "arrival long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get() if self.state.exists() else None
        out = []
        frames = [f for f in rows]
        for r in pd.concat(frames).sort_values("arrival").itertuples(index=False):
            if r.reset:
                if held is None:
                    continue  # a reset before the first window changes nothing
                held = (0, 0, 0, 0, 0, 0, held[6], held[7])
            else:
                identity = f"{r.process_id}/{r.window_id}/{r.sequence}/{r.pod_id}"
                if self.applied.containsKey((identity,)):
                    continue
                self.applied.updateValue((identity,), (int(r.arrival),))
                count, errors, size, p95, p99, sample, window, seen = held or (0, 0, 0, 0, 0, 0, None, None)
                if window is None or r.window_id > window:
                    sample, window, seen = 0, int(r.window_id), int(r.window_end_unix_nanos)
                    p95 = p99 = 0
                if r.window_id == window and r.count > sample:
                    p95, p99, sample = int(r.p95_nanos), int(r.p99_nanos), int(r.count)
                held = (count + int(r.count), errors + int(r.error_count), size + int(r.bytes), p95, p99, sample, window, seen)
            out.append((key[0], key[1], *held[:5], held[6], held[7], int(r.arrival)))
        if held is not None:
            self.state.update(held)
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in STATE.split(", ")])
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def device_changes(log: DataFrame) -> DataFrame:
    """The new state of a device after every emission applied and every reset; duplicates give nothing.

    ``log`` holds both: emissions with arrival and reset false, and resets with arrival and reset true.
    """
    return log.groupBy("user_id", "device_id").transformWithStateInPandas(statefulProcessor=_LiveState(), outputStructType=STATE, outputMode="Update", timeMode="None")


def watch_device(changes: DataFrame, device_id: str, after: int | None = None) -> DataFrame:
    """The changes of one device after a reader's place, the arrival of the last one that it has seen."""
    own = changes.where(F.col("device_id") == device_id)
    return own if after is None else own.where(F.col("arrival") > after)


def newest_changes(changes: DataFrame, after: int) -> DataFrame:
    """For slow readers: of each device its newest change after ``after``, and how many changes that skips."""
    rest = [c for c in changes.columns if c not in ("user_id", "device_id", "batch")]
    newer = changes.where(F.col("arrival") > after).groupBy("user_id", "device_id")
    return newer.agg(F.max_by(F.struct(*rest), "arrival").alias("x"), (F.count(F.lit(1)) - 1).alias("skipped")).select("user_id", "device_id", "x.*", "skipped")


ATTEMPTS = 3


def deliver(rows: DataFrame, n: int, number: str, good: Sink, batch_id: int, attempts: int = ATTEMPTS, most_refused: int = 10_000) -> dict[int, str]:
    """Give ``rows``, ``n`` of them told apart by ``number``, to ``good`` and return why those fail that it refuses.

    The rows go out as a whole. When that fails, halves are tried, and halves of halves that fail, down
    to single rows, each of which has ``attempts`` tries; so k bad rows among n cost some k log n
    tries, and the rows beside them are none the worse. Every call has the batch's number and must
    replace what the calls before it wrote for that batch; the last one has all rows that are left.
    If that one fails ``attempts`` times although each row passed, its failure is raised, and so is that
    of a row when more than ``most_refused`` have failed before it: then the sink is at fault.
    """

    def tried(low: int, high: int, without: list[int] = []) -> Exception | None:  # noqa: B006
        part = rows if (low, high) == (0, n) else rows.where(F.col(number).between(low, high - 1))
        if without:
            refused = rows.sparkSession.createDataFrame([(k,) for k in without], f"{number} long")
            part = part.join(F.broadcast(refused), number, "left_anti")
        try:
            good(part.drop(number), batch_id)
        except Exception as problem:  # noqa: BLE001  told to the caller
            return problem
        return None

    bad: dict[int, str] = {}
    todo: list[tuple[int, int]] = [(0, n)] if n else []
    whole = False  # whether the last call that succeeded had all rows
    while todo:
        low, high = todo.pop()
        problem = tried(low, high)
        for _ in range(attempts - 1 if high - low == 1 else 0):
            problem = problem and tried(low, high)
        whole = not problem and (low, high) == (0, n)
        if problem and high - low > 1:
            middle = (low + high) // 2
            todo += [(middle, high), (low, middle)]
        elif problem:
            if len(bad) == most_refused:
                raise problem
            bad[low] = f"{type(problem).__name__}: {problem}"[:500]
    if len(bad) < n and not whole:
        problem = tried(0, n, sorted(bad))
        for _ in range(attempts - 1):
            problem = problem and tried(0, n, sorted(bad))
        if problem:
            raise problem
    return bad


def handled(rows: DataFrame, message: str, handle: Callable[[dict], None], attempts: int = ATTEMPTS) -> DataFrame:
    """``rows`` with ``reason``: why ``handle`` failed for a row's ``message``, in the last of ``attempts`` tries; null if one passed.

    Tasks hand each message over by itself, so any number of bad ones takes one pass. Tasks may run
    again, so ``handle`` must bear to have a message more than once.
    """

    def failure(value: dict) -> str | None:
        said = None
        for _ in range(attempts):
            try:
                handle(value)
            except Exception as problem:  # noqa: BLE001  told to the caller
                said = f"{type(problem).__name__}: {problem}"[:500]
            else:
                return None
        return said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = pa.array(map(failure, batch[message].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, reasons], [*batch.schema.names, "reason"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("reason", T.StringType())]))


def split_poison(messages: DataFrame, schema: str, good: Sink, dead: Sink, origin: str, checkpoint: str, attempts: int = ATTEMPTS, handle: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Messages that parse go to ``good``, the others with reason and origin to ``dead``; then the batch is done.

    Each message that parses is first given to ``handle``, if any, in tasks (see ``handled``); one
    that fails ``attempts`` times goes to ``dead`` with its failure as the reason. So does one that
    ``good`` refuses as often; the batch's other messages are kept. That search takes some calls of
    ``good`` for every bad message (see ``deliver``, also for what ``good`` must allow), so work that
    fails by message belongs in ``handle``. A failure of ``dead`` fails the batch, which the checkpoint
    repeats; a bad message never does.
    """

    def handle_batch(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.withColumn("__v", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        malformed = F.col("__v").isNull() | F.col("__v._corrupt").isNotNull()
        parsed = written(parsed.withColumn("__bad", malformed), "messages")
        sound = parsed.where("not __bad")
        if handle is None:
            sound = sound.withColumn("reason", F.lit(None).cast("string"))
        else:  # written, so that each message is handed over in one pass
            sound = written(handled(sound.withColumn("__m", F.struct("key", "__v.*").dropFields("_corrupt")), "__m", handle, attempts).drop("__m"), "handled")
        passed = numbered(sound.where("reason is null").drop("reason"), "sound", "__number")
        refused = deliver(passed.select("__number", "key", "__v.*").drop("_corrupt"), passed.count(), "__number", good, batch_id, attempts)
        letter = lambda rows, reason: rows.select("key", "value", F.lit(origin).alias("origin"), reason.alias("reason"))
        letters = letter(parsed.where("__bad"), F.lit("malformed")).unionByName(letter(sound.where("reason is not null"), F.col("reason")))
        if refused:
            reasons = batch.sparkSession.createDataFrame(list(refused.items()), "__number long, reason string")
            letters = letters.unionByName(letter(passed.join(F.broadcast(reasons), "__number"), F.col("reason")))
        dead(letters, batch_id)

    return messages.writeStream.foreachBatch(handle_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
