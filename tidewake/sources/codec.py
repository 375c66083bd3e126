"""Wire forms of batches, emissions and commands, and the sources that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.windows import EMISSION

EVENT_FIELDS = "device_id string, user_id string, process_id int, pod_id string, kind int, observed_at_unix_nanos bigint, latency_nanos bigint, bytes bigint, failed boolean"
BATCH_SCHEMA = "device_id string, created_at_unix_nanos bigint, events array<struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split(" ") for x in EVENT_FIELDS.split(", "))) + ">>"
#: As on the wire, where numbers may be out of range.
WIDE_BATCH_SCHEMA = BATCH_SCHEMA.replace("process_id: int", "process_id: bigint").replace("kind: int", "kind: bigint")
WINDOW_SCHEMA = ", ".join(f"{c} {'string' if c in ('user_id', 'device_id', 'pod_id') else 'int' if c == 'process_id' else 'bigint'}" for c in EMISSION)
COMMAND_SCHEMA = "kind int, user_id string, device_id string, actor string, issued_at_unix_nanos bigint"


def _message(row: Column, key: str, fmt: str, message: str, descriptor: str | None) -> list[Column]:
    if fmt == "json":
        value = F.to_json(row)
    elif fmt == "protobuf":
        from pyspark.sql.protobuf.functions import to_protobuf

        value = to_protobuf(row, message, descriptor)
    else:
        raise ValueError("fmt must be json or protobuf")
    return [F.col(key).alias("key"), value.alias("value")]


def _decoded(value: Column, schema: str, fmt: str, message: str, descriptor: str | None) -> Column:
    if fmt == "json":
        return F.from_json(value.cast("string"), schema, {"mode": "PERMISSIVE"})
    if fmt == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        return from_protobuf(value, message, descriptor)
    raise ValueError("fmt must be json or protobuf")


def encode_batches(batches: DataFrame, fmt: str = "json", descriptor: str | None = None) -> DataFrame:
    """(key, value) messages, keyed by device so that one device's batches stay in order."""
    return batches.select(*_message(F.struct("device_id", "created_at_unix_nanos", "events"), "device_id", fmt, "Batch", descriptor))


def in_range(events: Column) -> Column:
    """Whether every event's kind fits 8 bits without sign and every process id 32 bits with one."""
    fits = lambda e, name, low, high: F.coalesce(e[name], F.lit(0)).between(low, high)
    return F.coalesce(F.forall(events, lambda e: fits(e, "kind", 0, 255) & fits(e, "process_id", -(1 << 31), (1 << 31) - 1)), F.lit(True))


def decode_batches(messages: DataFrame, fmt: str = "json", descriptor: str | None = None) -> DataFrame:
    """Events of (key, value) messages, one row each; absent numbers are zero.

    Messages that do not parse give none, and neither do those of which any event has a kind or
    process id out of range.
    """
    batch = messages.select(_decoded(F.col("value"), WIDE_BATCH_SCHEMA, fmt, "Batch", descriptor).alias("b")).where(in_range(F.col("b.events")))
    events = batch.select(F.col("b.device_id").alias("batch_device_id"), F.explode("b.events").alias("e"))
    zero = {"process_id": 0, "kind": 0, "latency_nanos": 0, "bytes": 0, "failed": False, "device_id": "", "user_id": "", "pod_id": ""}
    return events.select("batch_device_id", "e.*").withColumns({c: F.col(c).cast("int") for c in ("process_id", "kind")}).fillna(zero)


def encode_windows(emissions: DataFrame, fmt: str = "json", descriptor: str | None = None) -> DataFrame:
    """(key, value) messages, keyed by user."""
    return emissions.select(*_message(F.struct(*EMISSION), "user_id", fmt, "Window", descriptor))


def decode_windows(messages: DataFrame, fmt: str = "json", descriptor: str | None = None) -> DataFrame:
    return messages.select(_decoded(F.col("value"), WINDOW_SCHEMA, fmt, "Window", descriptor).alias("w")).where("w is not null").select("w.*")


def encode_commands(commands: DataFrame) -> DataFrame:
    return commands.select(*_message(F.struct("kind", "user_id", "device_id", "actor", "issued_at_unix_nanos"), "user_id", "json", "Command", None))


def decode_commands(messages: DataFrame) -> DataFrame:
    return messages.select(_decoded(F.col("value"), COMMAND_SCHEMA, "json", "Command", None).alias("c")).where("c is not null").select("c.*")


def read_messages(spark: SparkSession, source: str, stream: bool = True, files_per_trigger: int = 1) -> DataFrame:
    """(key, value) messages of a folder of Parquet files, or of a Kafka topic named ``kafka:servers/topic``, from the earliest."""
    if source.startswith("kafka:"):
        servers, _, topic = source.removeprefix("kafka:").rpartition("/")
        reader = spark.readStream if stream else spark.read
        return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("key").cast("string"), "value")
    if not stream:
        return spark.read.parquet(source)
    return spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", files_per_trigger).parquet(source)


def read_batches(spark: SparkSession, source: str, fmt: str = "json", stream: bool = True) -> DataFrame:
    return decode_batches(read_messages(spark, source, stream), fmt)


def read_windows(spark: SparkSession, source: str, fmt: str = "json", stream: bool = True) -> DataFrame:
    return decode_windows(read_messages(spark, source, stream), fmt)


def read_commands(spark: SparkSession, source: str, stream: bool = True) -> DataFrame:
    return decode_commands(read_messages(spark, source, stream))
