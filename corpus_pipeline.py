"""A pipeline over ``documents`` in stages, each written as Parquet and read by the next.

Every stage takes null and empty texts, null and repeated ids, repeated rows and empty tables; extra
columns pass through the stages that return documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import new_path
from tidewake.llm.decontamination import contamination
from tidewake.llm.jaccard import one_of_each_group
from tidewake.llm.pieces import sample_segmentations
from tidewake.llm.quality import fit_voters, score_quality


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: str, new: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` that meet the condition on the ``new`` columns of ``judge``; columns of ``docs`` with such names keep their values."""
    own = {c: f"own__{c}" for c in docs.columns if c in new}
    return judge(docs.withColumnsRenamed(own)).where(condition).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from all labels; texts that say nothing stand by the share of good labels."""
    voters = fit_voters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, lambda rows: score_quality(rows, voters), "predicted = 1", ("score", "predicted"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or exact copies; null texts are copies of nothing, empty ones of each other."""
    return one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item; texts without words share none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(docs, lambda rows: contamination(rows, items), "not contaminated", ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, a row each: ids, probabilities and the round trip; null is taken as empty."""
    rows = sample_segmentations(docs.select("doc_id", "text")).select("doc_id", F.posexplode("samples").alias("rank", "s"))
    return rows.select("doc_id", (F.col("rank") + 1).alias("rank"), "s.*")


STAGES = [
    ("quality", good_documents),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("segmentation", segmented),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
