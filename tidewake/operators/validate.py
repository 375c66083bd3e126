"""Validation of events, batches, requests, identifiers and commands: the first failing rule is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER_BYTES = 256
BODY_BYTES = 8 << 20
EDGE_SCHEMA = "device_id string, events array<struct<user_id: string, process_id: bigint, kind: bigint, observed_at_unix_nanos: bigint, latency_nanos: bigint, bytes: bigint, failed: boolean>>, _corrupt string"


def _first(*rules: tuple[Column, str]) -> Column:
    out = None
    for rule, reason in rules:
        out = F.when(rule, reason) if out is None else out.when(rule, reason)
    return out


def empty(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) == ""


def event_reason(get=F.col) -> Column:
    """Why an event is invalid, or null; kind 0 is valid and a missing number is zero."""
    zero = lambda c: F.coalesce(get(c), F.lit(0))
    return _first(
        (empty(get("device_id")), "empty device"),
        (empty(get("user_id")), "empty user"),
        (~zero("kind").between(0, 4), "unknown kind"),
        (zero("latency_nanos") < 0, "negative latency"),
        (zero("bytes") < 0, "negative bytes"),
        (get("observed_at_unix_nanos").isNull(), "zero timestamp"),
    )


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    marked = df.withColumn("reason", event_reason())
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def batch_reason(batch_device: Column, events: Column) -> Column:
    """Why a batch is refused as a whole: no device, its first bad event, or an event of another device."""
    own = lambda e: lambda c: e[c]
    reasons = F.transform(events, lambda e: F.coalesce(event_reason(own(e)), F.when(e["device_id"] != batch_device, "foreign event")))
    return F.when(empty(batch_device), "empty batch device").otherwise(F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0)))


def validate_batches(batches: DataFrame) -> DataFrame:
    """Batches with ``reason``, null for accepted ones. Their events hold a device_id each."""
    return batches.withColumn("reason", batch_reason(F.col("device_id"), F.col("events")))


def verify_identity(batches: DataFrame) -> DataFrame:
    """Batches with ``identity_reason``: the authenticated device must be that of the batch and of all its events."""
    own = F.col("authenticated_device_id")
    reason = _first((empty(own), "no identity"), (F.coalesce(F.col("device_id"), F.lit("")) != own, "identity mismatch"), (F.exists("events", lambda e: e["device_id"] != own), "identity mismatch"))
    return batches.withColumn("identity_reason", reason)


def accept_device_events(df: DataFrame, device: Column) -> DataFrame:
    """Events with ``accepted``: invalid ones and those of other devices are dropped one by one."""
    return df.withColumn("accepted", event_reason().isNull() & (F.col("device_id") == device))


def identifier_reason(column: Column) -> Column:
    """Length in bytes is checked before control characters."""
    return _first((F.octet_length(column) > IDENTIFIER_BYTES, "too long"), (column.rlike(r"[\x00-\x1f\x7f]"), "invalid"))


def validate_identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``reason`` of the first bad identifier."""
    return df.withColumn("reason", F.coalesce(*(identifier_reason(F.col(c)) for c in columns)))


def command_reason() -> Column:
    """Only resets (1) and quarantines (2) are commands; 0 is none."""
    return _first((~F.coalesce(F.col("kind"), F.lit(0)).isin(1, 2), "unknown kind"), (empty(F.col("user_id")), "empty user"), (empty(F.col("device_id")), "empty device"), (empty(F.col("actor")), "empty actor"))


def validate_commands(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", command_reason())


def decode_edge(requests: DataFrame) -> DataFrame:
    """Add ``payload``, the parsed body, and ``malformed``: not JSON, too long, or numbers out of range."""
    parsed = requests.withColumn("payload", F.from_json("body", EDGE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    far = F.exists(F.coalesce("payload.events", F.array()), lambda e: ~F.coalesce(e["kind"], F.lit(0)).between(0, 255) | ~F.coalesce(e["process_id"], F.lit(0)).between(-(1 << 31), (1 << 31) - 1))
    bad = F.col("payload").isNull() | F.col("payload._corrupt").isNotNull() | (F.octet_length("body") > BODY_BYTES) | F.coalesce(far, F.lit(False))
    return parsed.withColumn("malformed", bad)


def normalise_edge(requests: DataFrame, pod: str) -> DataFrame:
    """Add ``events`` as they are ingested: the authenticated device, the receiving pod, times and kinds put right."""

    def event(e: Column) -> Column:
        seen = F.coalesce(e["observed_at_unix_nanos"], F.lit(0))
        kind = F.coalesce(e["kind"], F.lit(0))
        zero = lambda c: F.coalesce(e[c], F.lit(0).cast("long"))
        return F.struct(
            F.col("authenticated_device_id").alias("device_id"),
            F.coalesce(e["user_id"], F.lit("")).alias("user_id"),
            zero("process_id").cast("int").alias("process_id"),
            F.lit(pod).alias("pod_id"),
            F.when(kind.between(0, 4), kind).otherwise(1).cast("int").alias("kind"),
            F.when(seen <= 0, F.col("received_at_unix_nanos")).otherwise(seen).alias("observed_at_unix_nanos"),
            zero("latency_nanos").alias("latency_nanos"),
            zero("bytes").alias("bytes"),
            F.coalesce(e["failed"], F.lit(False)).alias("failed"),
        )

    some = F.when(~F.col("malformed"), F.col("payload.events"))
    return requests.withColumn("events", F.transform(F.coalesce(some, F.array().cast("array<struct<user_id: string, process_id: bigint, kind: bigint, observed_at_unix_nanos: bigint, latency_nanos: bigint, bytes: bigint, failed: boolean>>")), event))


def accept_edge(requests: DataFrame, pod: str, allowed: DataFrame | None = None) -> DataFrame:
    """Requests with the ``status`` of the edge and the counter it adds to.

    ``allowed`` lists peer names; without it, every peer is allowed.
    """
    decoded = normalise_edge(decode_edge(requests), pod)
    if allowed is None:
        decoded = decoded.withColumn("__peer", F.lit(True))
    else:
        decoded = decoded.join(allowed.select(F.col("peer_cn"), F.lit(True).alias("__peer")).distinct(), "peer_cn", "left")
    own = F.col("authenticated_device_id")
    status = (
        F.when(F.col("__peer").isNull(), 403)
        .when(empty(own), 401)
        .when(F.col("malformed"), 400)
        .when(~empty(F.col("payload.device_id")) & (F.col("payload.device_id") != own), 403)
        .when(batch_reason(own, F.col("events")).isNotNull(), 400)
        .otherwise(202)
    )
    counter = F.when(F.col("status") == 202, "http_ingest_accepted").when((F.col("status") == 401) | F.col("__peer").isNull(), "http_ingest_unauthenticated").otherwise("http_ingest_rejected")
    return decoded.withColumn("status", status).withColumn("counter", counter).drop("__peer")


def dead_letter(df: DataFrame, origin: str, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): key and value as they came, with where from and why."""
    good = df.where(F.col(reason).isNull()).drop(reason)
    return good, df.where(F.col(reason).isNotNull()).select("key", "value", F.lit(origin).alias("origin"), F.col(reason).alias("reason"))
