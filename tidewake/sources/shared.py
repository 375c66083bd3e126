"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, as in tests, a temporary folder where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_tidewake_base", None)
        if base is None:
            base = spark._tidewake_base = tempfile.mkdtemp(prefix="spark-tidewake-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidewake-{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, label: str, name: str) -> DataFrame:
    """``df`` written with ``name``, a number from 0 without gaps for each row; only counts of partitions are gathered."""
    spark = df.sparkSession
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = written(df.withColumns({"__part": F.spark_partition_id(), "__within": within}), label)
    begin, starts = 0, []
    for part, n in sorted(rows.groupBy("__part").count().collect()):
        starts.append((part, begin))
        begin += n
    starts = spark.createDataFrame(starts, "__part int, __begin long")
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__begin") + F.col("__within")).drop("__part", "__within", "__begin")
