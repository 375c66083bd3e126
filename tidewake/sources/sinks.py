"""Sinks for micro-batches: fan-out, batches as folders, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, int], None]


def fan_out(sinks: dict[str, Sink]) -> Sink:
    """A sink that writes every batch to all of ``sinks``, later ones also after a failure, and raises the first one's."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        first: Exception | None = None
        try:
            for sink in sinks.values():
                try:
                    sink(batch, batch_id)
                except Exception as problem:  # noqa: BLE001  raised below, once all have had the batch
                    first = first or problem
        finally:
            batch.unpersist()
        if first is not None:
            raise first

    return write


def append_parquet(path: str) -> Sink:
    """One folder for each batch, which a retry writes again."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_metrics(path: str) -> Sink:
    """Append (name, delta) rows under their batch."""
    return lambda batch, batch_id: batch.select("name", "delta").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("name", "delta", F.col("batch_id").cast("long").alias("batch_id"))
