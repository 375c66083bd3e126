"""The day-partitioned archive of emissions: idempotent writes, pruned reads, retention, erasure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.keys import IDENTITY, window_day

ARCHIVE_KEY = [*IDENTITY, "window_start_unix_nanos"]


def with_day(emissions: DataFrame) -> DataFrame:
    return emissions.withColumn("window_day", window_day(F.col("window_start_unix_nanos")))


def scan_archive(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """The archive's rows; with ``days`` only those days' folders are read."""
    df = spark.read.option("basePath", path).parquet(path).withColumn("window_day", F.col("window_day").cast("string"))
    return df if days is None else df.where(F.col("window_day").isin(days))


def new_rows(emissions: DataFrame, archive: DataFrame | None) -> DataFrame:
    """Emissions, once each, that the archive does not hold yet."""
    once = with_day(emissions).dropDuplicates(ARCHIVE_KEY)
    return once if archive is None else once.join(archive.select("window_day", *ARCHIVE_KEY), ["window_day", *ARCHIVE_KEY], "left_anti").select(once.columns)


def archive_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place))


def write_archive(emissions: DataFrame, path: str) -> tuple[int, int]:
    """Append what is new and return (inserted, duplicate); writing the same rows again inserts none.

    Only the days that the emissions touch are read for the comparison.
    """
    spark = emissions.sparkSession
    emissions = emissions.persist()
    try:
        total = emissions.count()
        held = None
        if archive_exists(spark, path):
            days = [r[0] for r in with_day(emissions).select("window_day").distinct().collect()]
            held = scan_archive(spark, path, days)
        fresh = new_rows(emissions, held).persist()
        inserted = fresh.count()
        # a day of many rows is split over several tasks and files
        fresh.hint("rebalance", "window_day").write.mode("append").partitionBy("window_day").parquet(path)
        fresh.unpersist()
        return inserted, total - inserted
    finally:
        emissions.unpersist()


def repartition_by_day(archive: DataFrame) -> DataFrame:
    """Rows under the day they belong to, once each: what re-files rows that stood elsewhere."""
    return with_day(archive.drop("window_day")).dropDuplicates(ARCHIVE_KEY)


def drop_days_before(archive: DataFrame, cutoff_day: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, days dropped) for whole days strictly before the cutoff's."""
    old = archive.where(F.col("window_day") < cutoff_day)
    return archive.where(F.col("window_day") >= cutoff_day), old.select("window_day").distinct()


def erase_device(archive: DataFrame, user_id: str, device_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, (days touched, rows erased)); none erased means not found."""
    own = (F.col("user_id") == user_id) & (F.col("device_id") == device_id)
    gone = archive.where(own).groupBy("window_day").agg(F.count(F.lit(1)).alias("erased"))
    return archive.where(~F.coalesce(own, F.lit(False))), gone


def erase_device_files(spark: SparkSession, path: str, user_id: str, device_id: str) -> int:
    """Rewrite the days that hold a device without it and return the rows erased."""
    whole = scan_archive(spark, path)
    _, gone = erase_device(whole, user_id, device_id)
    touched = gone.collect()
    if touched:
        days = [r["window_day"] for r in touched]
        kept, _ = erase_device(scan_archive(spark, path, days), user_id, device_id)
        # a day's files are read while they are replaced, so the new rows are written aside first
        aside = f"{path.rstrip('/')}_rewrite_{uuid.uuid4().hex}"  # of this erasure alone
        kept.write.mode("overwrite").partitionBy("window_day").parquet(aside)
        spark.read.schema(kept.schema).parquet(aside).withColumn("window_day", F.col("window_day").cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_day").parquet(path)
        left = {r[0] for r in spark.read.schema(kept.schema).parquet(aside).select(F.col("window_day").cast("string")).distinct().collect()}
        for day in set(days) - left:  # a day of this device alone
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/window_day={day}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return sum(r["erased"] for r in touched)
