"""Counters observed in flight: what a running stream counts beside its work, written by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(rows: DataFrame, name: str, counters: dict[str, Column]) -> DataFrame:
    """``rows``, of which a stream also counts those that meet each counter's condition, without a pass of its own."""
    return rows.observe(name, *(F.count_if(when).alias(counter) for counter, when in counters.items()))


class ObservedCounters(StreamingQueryListener):
    """Writes (name, delta) of the observation ``name`` under each micro-batch; a repeated batch writes the same rows again."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            deltas = [(counter, value) for counter, value in row.asDict().items() if value]
            self.spark.createDataFrame(deltas, "name string, delta long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={event.progress.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def settled(self) -> None:
        """Wait until the events of queries that have ended are written."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
