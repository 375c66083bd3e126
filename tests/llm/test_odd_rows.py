"""Odd rows through the pipeline's stages, ids of other types, items of very many windows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_corpus import documents, prose
from tidewake.llm import decontamination, quality

DATA = "/root/testdata/sf0.001"
NEW = ["score", "predicted", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def odd(spark):
    """Documents with null and empty texts, null and repeated ids, repeated rows, a long text and columns that clash."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.where("doc_id < 60")
    long = docs.where("doc_id < 8").select(F.lit(900_001).cast("long").alias("doc_id"), F.array_join(F.collect_list("text"), " ").alias("text"))
    rows = some.unionByName(some.where("doc_id % 20 = 0")).unionByName(long, allowMissingColumns=True)
    rows = rows.unionByName(spark.createDataFrame([(None, None), (None, ""), (900_002, None), (900_003, ""), (900_003, " \t\n"), (900_004, "one")], "doc_id long, text string"), allowMissingColumns=True)
    return rows.withColumns({c: F.lit(f"own {c}") for c in NEW})


def counted(df):
    return collections.Counter(tuple(str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_that_filter_return_their_own_rows(spark, k):
    docs = odd(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
    assert out.columns == docs.columns
    given, got = counted(docs), counted(out)
    assert got and not got - given
    assert corpus_pipeline.STAGES[k][1](spark, docs.where("false"), DATA).count() == 0


def test_stages_keep_what_they_should(spark):
    docs = odd(spark)
    single = corpus_pipeline.without_near_copies(spark, docs, DATA)
    texts = [r["text"] for r in single.collect()]
    assert texts.count(None) == 2 and texts.count("") == 1  # a null text is a copy of nothing
    clean = corpus_pipeline.without_benchmark(spark, docs, DATA)
    assert counted(docs.where("coalesce(trim(text), '') = ''")) == counted(clean.where("coalesce(trim(text), '') = ''"))
    parts = corpus_pipeline.segmented(spark, docs.where("doc_id >= 900000 or doc_id is null"), DATA)
    assert parts.where("not round_trip").count() == 0 and {r["doc_id"] for r in parts.collect()} >= {None, 900_001, 900_002, 900_003, 900_004}
    assert corpus_pipeline.segmented(spark, docs.where("false"), DATA).count() == 0


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)"])
def test_quality_takes_ids_of_any_type(spark, kind):
    rng = random.Random(10)
    texts = [prose(rng, 80).replace("w1", "W1") + "." if i % 2 else " ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for i in range(120)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120) if i % 3], "doc_id long, quality int")
    want = quality.fit_voters(docs, labels)
    got = quality.fit_voters(*(x.withColumn("doc_id", F.col("doc_id").cast(kind)) for x in (docs, labels)))
    assert len(got.labels) == len(want.labels) == 80 and sorted(got.labels) == sorted(want.labels)
    assert quality.score_quality(docs, got).where(F.col("predicted") != F.col("doc_id") % 2).count() == 0


def test_items_of_more_windows_than_a_task_holds(spark):
    rng = random.Random(3)
    body = [f"{rng.randrange(10**6)}x" for _ in range(decontamination.HELD + 40)]
    items = spark.createDataFrame([("book", " ".join(body)), ("tail", " ".join(body[-12:]))], "item_id string, text string")
    docs = documents(spark, [" ".join(body), "a " + " ".join(body[decontamination.HELD - 3 : decontamination.HELD + 7]) + " b", " ".join(body[:9]), " ".join(body[-10:])])
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {0: (len(body), 2), 1: (10, 1), 2: (0, 0), 3: (10, 2)}
