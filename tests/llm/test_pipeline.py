"""The pipeline on the smallest tables against plain versions of its stages, and its place in the entry."""

import importlib

import pytest

import corpus_pipeline
from tests.llm.test_corpus import brute_hits, brute_links

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = stage(spark, docs, DATA).cache()
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(out[n].columns == columns for n in ("quality", "near_copies", "decontamination"))
    good = [r["doc_id"] for r in out["quality"].collect()]
    assert sum(labels.get(i, 1) for i in good) >= 0.95 * len(good)
    texts = {r["doc_id"]: r["text"] for r in out["quality"].collect()}
    links = brute_links(list(texts.values()))
    kept = {r["doc_id"]: r["text"] for r in out["near_copies"].collect()}
    assert not brute_links(list(kept.values())) and len(set(kept.values())) == len(kept)
    assert all(i in kept for i, t in texts.items() if not links[t] and list(texts.values()).count(t) == 1)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in out["decontamination"].collect()}
    assert clean == {i for i, t in kept.items() if not brute_hits(t, items)[1]}
    rows = out["segmentation"].collect()
    assert {r["doc_id"] for r in rows} == clean and all(r["round_trip"] for r in rows)


def test_run_equals_its_stages_and_is_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert corpus_pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["op2_warc", "op4_jaccard", "op6_decontamination", "op10_topk", "op11_repeats", "op12_prefix_trie", "op13_merkle"])
def test_sql(spark, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
