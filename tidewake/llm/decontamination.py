"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of ten consecutive words must be found whole in a document. The tokens of a
window are its word shingles. A document that contains a window holds all its tokens, so one
token suffices as the necessary prefix: the rarest in the documents. Documents look their
shingles up in a Bloom filter that follows the items' size, the survivors meet the prefix tokens in a shuffle
join, bounds on position and length drop windows that would not fit, and the words themselves
are compared last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.common import ROW, Bloom, WordHashes, bloom_of, byte_values, gram_hashes, keyed_rows, materialise, words

WINDOW, SHINGLE = 10, 5
HELD = 20_000  # windows of items that a task holds at a time


def item_windows(items: DataFrame, key: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item, m, body, tokens): each window's word count, words and shingle hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = WordHashes(), []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64())))], ["item", "m", "body", "tokens"])
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                found = words(data)
                m = min(window, len(found))
                tokens = gram_hashes(known.of(found), min(shingle, m)).view(np.int64) if m else []
                count = m - min(shingle, m) + 1
                for i in range(len(found) - m + 1 if m else 0):
                    out.append((item, m, b" ".join(found[i : i + m]).decode("utf-8", "replace"), tokens[i : i + count].tolist()))
                    if len(out) == HELD:
                        yield packed()
                        out = []
        yield packed()

    return items.select(F.col(key).cast("string").alias("item"), text).mapInArrow(run, "item string, m int, body string, tokens array<long>")


def _scan(docs: DataFrame, text: str, lengths: list[int], bloom: Bloom, count_only: bool, reach: int) -> DataFrame:
    """What the documents hold of the filter's tokens: counts of each, or a row per document with its places."""
    shared = docs.sparkSession.sparkContext.broadcast((bloom.bits, bloom.seen))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, total = WordHashes(), Bloom(*shared.value), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["hash", "n"])
        for batch in batches:
            for data in byte_values(batch.column(1)):
                hashes = known.of(words(data))
                for length in lengths:
                    grams = gram_hashes(hashes, length)
                    if len(grams):
                        total.update(np.unique(grams[held.holds(grams)]).view(np.int64).tolist())
                if len(total) > 200_000:
                    yield flush()
                    total.clear()
        yield flush()

    near = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("near", pa.list_(pa.string()))]))

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = WordHashes(), Bloom(*shared.value)
        for batch in batches:
            rows, pending = ([], [], []), 0
            for k, data in enumerate(byte_values(batch.column(1))):
                found = words(data)
                hashes, hits = known.of(found), []
                for length in lengths:
                    grams = gram_hashes(hashes, length)
                    for p in np.flatnonzero(held.holds(grams)).tolist() if len(grams) else ():
                        first = max(0, p - reach)
                        hits.append({"hash": int(grams[p].view(np.int64)), "at": p, "first": first, "near": [w.decode("utf-8", "replace") for w in found[first : p + reach + length]]})
                for column, value in zip(rows, (batch.column(0)[k].as_py(), len(found), hits), strict=True):
                    column.append(value)
                pending += len(hits)
                if pending > 20_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), near), strict=True)], [ROW, "n_words", "hits"])
                    rows, pending = ([], [], []), 0

    schema = "hash long, n long" if count_only else f"{ROW} long, n_words long, hits array<struct<hash: long, at: int, first: int, near: array<string>>>"
    return docs.select(ROW, text).mapInArrow(counted if count_only else found_in, schema)


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents, passages): (row key, n_words) and (row key, item, start, m) of windows found.

    ``docs`` has the column ``ROW``. Words: A-Z lowered, runs of letters, digits and non-ASCII
    characters. Items without words have no window; items of fewer words than ``window`` are one.
    """
    parts = materialise(item_windows(items, item_key, item_text, window, shingle), "windows")
    lengths = sorted(r.n for r in parts.select(F.least("m", F.lit(shingle)).alias("n")).distinct().collect())
    tokens = parts.select(F.explode("tokens").alias("hash"))
    counts = _scan(docs, text, lengths, bloom_of(tokens), True, 0).groupBy("hash").agg(F.sum("n").alias("df"))
    exploded = parts.withColumn("window", F.monotonically_increasing_id()).select("window", "item", "m", "body", F.posexplode("tokens").alias("offset", "hash"))
    # hash order settles ties, so that neighbouring windows choose the same token
    rarest = exploded.join(counts, "hash", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "hash", "offset", "item", "m", "body")).alias("x"))
    prefix = materialise(rarest.select("x.*").groupBy("hash", "body", "offset", "m").agg(F.collect_set("item").alias("items")).groupBy("hash").agg(F.collect_list(F.struct("items", "offset", "m", "body")).alias("windows")), "prefix")
    hits = materialise(_scan(docs, text, lengths, bloom_of(prefix.select("hash")), False, window), "hits")
    met = hits.select(ROW, "n_words", F.explode("hits").alias("hit")).select(ROW, "n_words", "hit.*").join(prefix, "hash")
    fits = F.filter(
        "windows",
        lambda w: (F.col("at") >= w["offset"])
        & (F.col("at") - w["offset"] + w["m"] <= F.col("n_words"))
        & (F.array_join(F.slice("near", F.col("at") - w["offset"] - F.col("first") + 1, w["m"]), " ") == w["body"]),
    )
    found = met.select(ROW, F.col("at"), F.explode(fits).alias("w"))
    return hits.select(ROW, "n_words"), found.select(ROW, (F.col("at") - F.col("w.offset")).alias("start"), F.col("w.m").alias("m"), F.col("w.items").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: its columns, and what it shares with the items.

    n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the items'
    ids, sorted as text, comma-joined; of nothing if none) and contaminated. Null and empty texts
    have no words; repeated rows are rows of their own; item ids may be of any type and are compared
    as text; null ones count as no item but their windows still hit; either table may be empty. New columns replace ones of the same name.
    """
    keyed = keyed_rows(docs)
    sizes, passages = find_passages(keyed, items, text, **options)
    stretch = passages.groupBy(ROW, "start", "m").agg(F.flatten(F.collect_list("items")).alias("items"))
    before = Window.partitionBy(ROW).orderBy("start", "m").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("m") - F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("m")).over(before), F.lit(0))))
    per_row = stretch.withColumn("fresh", fresh).groupBy(ROW).agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    verdict = sizes.join(per_row, ROW, "left").select(
        ROW,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    return keyed.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated").join(verdict, ROW).drop(ROW)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark's windows of ten words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wi AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM wi),
wd AS (
  SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS body
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)
), hit AS (SELECT wd.r, wd.p, wd.m, wi.item_id FROM wd JOIN wi ON wd.m = wi.m AND wd.body = wi.body),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
