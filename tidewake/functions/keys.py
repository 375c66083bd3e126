"""Columns derived from events, windows and commands: identities, window numbers, names, days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["user_id", "device_id", "process_id", "pod_id"]
IDENTITY = [*KEY, "window_id", "sequence"]
DAY_NANOS = 86_400_000_000_000

# The names of the wire's numbers.
KIND_NAMES = {0: "unknown", 1: "syscall", 2: "network", 3: "process_exec", 4: "process_exit"}
COMMAND_NAMES = {1: "reset_counters", 2: "quarantine_device"}


def with_correlation_key(df: DataFrame) -> DataFrame:
    """Add the text forms of the key and of its device scope; group by the columns, never by these."""
    scope = F.concat(F.lit("{"), "user_id", F.lit("}:"), "device_id")
    key = F.concat(scope, F.lit(":"), F.col("process_id").cast("string"), F.lit(":"), "pod_id")
    return df.withColumns({"correlation_key": key, "device_scope": scope})


def with_identity(df: DataFrame) -> DataFrame:
    """Add ``window_key`` (key#window) and ``identity`` (key#window#sequence)."""
    df = with_correlation_key(df)
    window = F.concat("correlation_key", F.lit("#"), F.col("window_id").cast("string"))
    return df.withColumns({"window_key": window, "identity": F.concat(window, F.lit("#"), F.col("sequence").cast("string"))})


def with_window(df: DataFrame, size_nanos: int) -> DataFrame:
    """Add the tumbling window of each event: its number and its start and end in nanoseconds."""
    if size_nanos <= 0:
        raise ValueError("the window size must be positive")
    number = F.expr(f"observed_at_unix_nanos div {size_nanos}")
    return df.withColumns({"window_id": number, "window_start_unix_nanos": number * size_nanos, "window_end_unix_nanos": (number + 1) * size_nanos})


def _named(column: Column, names: dict[int, str]) -> Column:
    out = F.lit("unknown")
    for number, name in names.items():
        out = F.when(column == number, name).otherwise(out)
    return out


def kind_name(column: Column) -> Column:
    return _named(column, KIND_NAMES)


def command_name(column: Column) -> Column:
    return _named(column, COMMAND_NAMES)


def classify_failed(ret: Column) -> Column:
    """A system call failed if it returned an error number."""
    return ret.between(-4095, -1)


def metric_export_name(name: Column, prefix: str = "tidewake") -> Column:
    """Name of a counter as exported: lower case, only letters, digits and inner underscores."""
    plain = F.lower(F.trim(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), F.lit("_")))
    return F.concat(F.lit(f"{prefix}_"), F.when(plain == "", "unnamed").otherwise(plain), F.lit("_total"))


def window_day(nanos: Column) -> Column:
    """UTC day, as yyyyMMdd, of a time in nanoseconds."""
    return F.date_format(F.timestamp_micros(F.floor(nanos / 1000).cast("long")), "yyyyMMdd")


def rfc3339(nanos: Column) -> Column:
    """Time of second precision, or an empty text where there is none."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.floor(nanos / 1_000_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def resolve_actor(commands: DataFrame, principals: DataFrame, admin: str = "admin") -> DataFrame:
    """Add ``actor``: the claimed one without a principal or for an admin who claims one, else the principal's own id."""
    known = principals.select("principal", F.col("user_id").alias("__own"), F.array_contains("scopes", admin).alias("__admin"))
    claimed = F.coalesce("claimed_actor", F.lit(""))
    actor = F.when(F.col("__own").isNull() | (F.col("__admin") & (claimed != "")), claimed).otherwise(F.col("__own"))
    return commands.join(known, "principal", "left").withColumn("actor", actor).drop("__own", "__admin")


def parse_principals(df: DataFrame, column: str = "spec") -> DataFrame:
    """(token, user_id, scopes) of each entry token:user[:scope|scope] of a comma-separated text.

    Entries without a token or user are left out; the third part keeps further colons; of
    repeated tokens in a text the last entry counts.
    """
    entries = df.select(F.monotonically_increasing_id().alias("__row"), F.posexplode(F.split(column, ",")).alias("at", "entry"))
    parts = F.split(F.trim("entry"), ":", 3)
    last = F.get(parts, F.lit(2))
    scopes = F.when(F.coalesce(last, F.lit("")) != "", F.split(last, r"\|")).otherwise(F.array().cast("array<string>"))
    out = entries.select("__row", "at", F.get(parts, F.lit(0)).alias("token"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("user_id"), scopes.alias("scopes"))
    best = out.where("token <> '' and user_id <> ''").groupBy("__row", "token").agg(F.max_by(F.struct("user_id", "scopes"), "at").alias("x"))
    return best.select("token", "x.*")


def shard(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """Deal rows into ``n`` partitions, all rows of a key into one, each partition in the given order.

    Consumers of a partition then see every key's rows as they came. Which partition a key has
    follows Spark's own hash and ``n`` alone.
    """
    return df.repartition(n, *by).sortWithinPartitions(*order)
