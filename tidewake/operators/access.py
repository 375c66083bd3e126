"""Tenant checks, reads with a fallback, commands and the requests made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.keys import resolve_actor
from tidewake.operators.state import DEVICE, list_devices, state_output
from tidewake.operators.validate import command_reason, empty, identifier_reason

ADMIN = "admin"


def authorise(requests: DataFrame, principals: DataFrame, auth_required: bool = True, admin_only: bool = False) -> DataFrame:
    """Requests with ``allowed``: for an admin, or for the user asked about; without a principal only if none is required."""
    known = principals.select("principal", F.col("user_id").alias("__own"), F.array_contains("scopes", ADMIN).alias("__admin"))
    own = F.lit(False) if admin_only else ~empty(F.col("user_id")) & (F.col("__own") == F.col("user_id"))
    verdict = F.when(F.col("__own").isNull(), F.lit(not auth_required)).otherwise(F.col("__admin") | own)
    return requests.join(known, "principal", "left").withColumn("allowed", verdict).drop("__own", "__admin")


def tenant_filter(requests: DataFrame, principals: DataFrame) -> DataFrame:
    return authorise(requests, principals).where("allowed").drop("allowed")


def read_with_fallback(requests: DataFrame, hot: DataFrame, archive: DataFrame, hot_available: bool = True) -> DataFrame:
    """Requests with their device's state: the hot answer, where a miss stays a miss, or the archive's when hot is down."""
    source = state_output(hot if hot_available else archive)
    return requests.join(source, DEVICE, "left").withColumn("found", F.col("count").isNotNull())


def apply_commands(commands: DataFrame, state: DataFrame) -> DataFrame:
    """Commands with their ``outcome``: a reset of a known device is applied, others are rejected."""
    known = state.select(*DEVICE, F.lit(True).alias("__known")).distinct()
    outcome = F.when(F.col("kind") != 1, "unsupported").when(F.col("__known").isNull(), "not found").otherwise("applied")
    return commands.join(known, DEVICE, "left").withColumn("outcome", outcome).drop("__known")


def issue_resets(requests: DataFrame, principals: DataFrame) -> DataFrame:
    """Reset requests with ``verdict``; accepted ones are commands to append, with their actor."""
    marked = authorise(resolve_actor(requests, principals), principals).withColumn("kind", F.lit(1))
    verdict = F.coalesce(
        F.when(empty(F.col("user_id")) | empty(F.col("device_id")), "missing identifier"),
        identifier_reason(F.col("user_id")),
        identifier_reason(F.col("device_id")),
        F.when(~F.col("allowed"), "forbidden"),
        command_reason(),
        F.lit("accepted"),
    )
    return marked.withColumn("verdict", verdict).drop("allowed")


def get_device_state(requests: DataFrame, principals: DataFrame, hot: DataFrame, archive: DataFrame, hot_available: bool = True) -> DataFrame:
    """One answer for each request: a refusal, not found, or the state."""
    asked = authorise(requests, principals)
    refused = F.coalesce(
        F.when(empty(F.col("user_id")) | empty(F.col("device_id")), "missing identifier"),
        identifier_reason(F.col("user_id")),
        identifier_reason(F.col("device_id")),
        F.when(~F.col("allowed"), "forbidden"),
    )
    answered = read_with_fallback(asked.withColumn("__refused", refused), hot, archive, hot_available)
    status = F.coalesce("__refused", F.when(F.col("found"), "ok").otherwise("not found"))
    shown = lambda c: F.when(status == "ok", F.col(c)).alias(c)
    return answered.select("request_id", "principal", *DEVICE, status.alias("status"), *map(shown, ("count", "error_count", "bytes", "p95_nanos", "p99_nanos", "last_window_id", "last_seen", "stale")))


def get_user_devices(requests: DataFrame, principals: DataFrame, state: DataFrame, limit: int = 500) -> DataFrame:
    """Each request's listing, or its refusal."""
    asked = authorise(requests, principals)
    refused = F.coalesce(F.when(empty(F.col("user_id")), "missing identifier"), identifier_reason(F.col("user_id")), F.when(~F.col("allowed"), "forbidden"))
    status = F.coalesce(refused, F.lit("ok"))
    joined = asked.withColumn("status", status).join(list_devices(state, limit), "user_id", "left")
    ok = F.col("status") == "ok"
    return joined.select("request_id", "principal", "user_id", "status", F.when(ok, F.coalesce("devices", F.array().cast("array<string>"))).alias("devices"), F.when(ok, F.coalesce("count", F.lit(0))).alias("count"), F.when(ok, F.coalesce("truncated", F.lit(False))).alias("truncated"))


def get_pipeline_metrics(requests: DataFrame, principals: DataFrame, metrics: DataFrame) -> DataFrame:
    """(request_id, name, value) for each request of an admin; others get a row without a name."""
    asked = authorise(requests, principals, admin_only=True)
    # the known counters are a few dozen names
    counters = metrics.agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("m"))
    rows = asked.join(F.broadcast(counters)).select("request_id", "allowed", F.explode_outer(F.when(F.col("allowed"), F.col("m"))).alias("x"))
    return rows.select("request_id", "allowed", F.col("x.name").alias("name"), F.col("x.value").alias("value"))
