"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed byte trigrams, once of its lower-cased bytes and once of their shapes
(letter, capital, digit, space, other), and a bin for how often a word repeats the one before it.
Term weights come from document frequencies over all documents. A truncated singular value
decomposition of a bounded, balanced sample of labelled texts gives the latent space; the
sample's vectors are broadcast, every document's exact cosines with all of them are computed in
blocks, and the nearest vote with weights that fall steeply with distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import byte_values, crc_mod

PLACES = 1024  # hashed places of each kind of trigram
REPEAT_BINS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4])
TERMS = 2 * PLACES + len(REPEAT_BINS) + 1
SHAPES = bytes(97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in b" \t\r\x0b\x0c" else b for b in range(256))


def _trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(22), minlength=PLACES)


def term_counts(data: bytes) -> np.ndarray:
    """Counts of a text's terms; all zero for one of under three bytes."""
    out = np.zeros(TERMS, np.float32)
    if len(data) >= 3:
        out[:PLACES] = _trigrams(data.lower())
        out[PLACES : 2 * PLACES] = _trigrams(data.translate(SHAPES))
        found = data.split()
        if found:
            again = sum(map(bytes.__eq__, found, found[1:])) / len(found)
            out[2 * PLACES + int(np.searchsorted(REPEAT_BINS, again, "right"))] = max(1, len(found) // 2)
    return out


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(documents, documents with each term), summed in the tasks first and then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for data in byte_values(batch.column(0)):
                df[:TERMS] += term_counts(data) > 0
                n += 1
        df[TERMS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(df)], ["term", "n"])

    total = docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(TERMS + 1, np.int64)
    df[total["term"].to_numpy()] = total["n"].to_numpy()
    return int(df[TERMS]), df[:TERMS]


@dataclass
class Voters:
    """Labelled vectors in the latent space and what is needed to put other texts there."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    class_weight: tuple[float, float]
    neighbours: int
    sharpness: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = self.weighted(counts) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors; the prior where nothing is similar."""
        prior = self.class_weight[1] * (self.labels == 1).sum() / max(1e-9, sum(self.class_weight[k] * (self.labels == k).sum() for k in (0, 1))) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        near = self.latent(counts) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        pull = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** self.sharpness
        pull *= np.where(self.labels[at] == 1, self.class_weight[1], self.class_weight[0])
        ones = (pull * (self.labels[at] == 1)).sum(axis=1)
        weight = 1e-6
        return (ones + weight * prior) / (pull.sum(axis=1) + weight)


def fit_voters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", usable: Column | None = None, most_labelled: int = 4000, dims: int = 48, neighbours: int = 25, sharpness: float = 12.0) -> Voters:
    """Learn from at most ``most_labelled`` labelled texts, half of each label, chosen by id hash; ids may be of any type.

    Labels other than 0 and 1 and null ids are ignored; of several labels of one id the larger
    mean wins. The bound keeps the broadcast vectors at ``most_labelled * dims`` numbers.
    """
    n, df = document_frequencies(docs, text)
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if usable is None else usable))
    marked = marked.groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    held = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    sample = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most_labelled // 2)
        sample = some if sample is None else sample.unionByName(some)
    priors = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.log1p(term_counts(data)).astype(np.float16).tobytes() for data in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["k", "y", "x"])

    # the sample is bounded, so its ids are safe to broadcast; repeated ids keep one row
    found = held.join(F.broadcast(sample), "k").select("k", "t", "y")
    texts = found.mapInArrow(run, T.StructType([found.schema["k"], T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())]))
    got = texts.groupBy("k").agg(F.min(F.struct("y", "x")).alias("v")).select("k", "v.*").orderBy("k").toArrow()
    y = np.array(got["y"].to_pylist(), np.int64)
    counts = np.expm1(np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(y), TERMS).astype(np.float32))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.2)
    share = {k: priors.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    voters = Voters(idf, np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), y, (share[0], share[1]), neighbours, sharpness)
    if len(y):
        x = voters.weighted(counts)
        values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
        voters.axes = np.ascontiguousarray(axes[:, ::-1][:, : min(dims, len(y))]).astype(np.float32)
        voters.vectors = voters.latent(counts)
    return voters


def score_quality(docs: DataFrame, voters: Voters, text: str = "text", block: int = 256) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= 0.5).

    Every row is scored from its whole text alone; null and empty texts get the prior. Columns of
    the same names are replaced, all others kept.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(vars(voters))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Voters(**shared.value)
        for batch in batches:
            scores, waiting = [], []
            for data in byte_values(batch.column(place)):
                waiting.append(term_counts(data))
                if len(waiting) == block:
                    scores.append(model.scores(np.array(waiting)))
                    waiting = []
            if waiting:
                scores.append(model.scores(np.array(waiting)))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality, voted by labelled texts outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    voters = fit_voters(docs, labels, usable=crc_mod(F.col("doc_id"), 3) != 1)
    # the text itself need not come back from the scoring tasks
    scored = score_quality(docs, voters)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
