"""N-gram Jaccard join with Bayesian candidate pruning.

Equal texts are one class and texts with equal shingles one set, so copies cost nothing more.
MinHash bands propose pairs of sets. Within a bucket of a band a pair's MinHash values are compared
a few at a time, and it is dropped as soon as the posterior probability that its similarity
reaches the threshold, given the matches so far and a uniform prior, falls below the tolerance.
The survivors make components, in which pairs are verified on the shingles themselves, block by
block. Pairs never become rows: buckets yield a spanning forest of their survivors, and blocks
every set's number of links and a forest of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import ROW, Bloom, WordHashes, bloom_of, byte_values, keyed_rows, materialise, shingle_hashes, words
from tidewake.llm.graph import components

SHINGLE, BANDS, BAND_ROWS, STEP = 5, 24, 4, 16
VALUES = BANDS * BAND_ROWS
FACTORS = np.random.default_rng(7).integers(1 << 62, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
MASKS = np.random.default_rng(8).integers(0, 1 << 63, VALUES, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of distinct shingles; the greatest value for none."""
    out = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 2048):
        np.minimum(out, ((shingles[i : i + 2048, None] ^ MASKS) * FACTORS).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def fewest_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Least number of equal values among ``compared`` at which P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the
    chance that of n + 1 trials with chance t at most m succeed.
    """
    chance = 0.0
    for m in range(compared + 1):
        chance += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if chance >= tolerance:
            return m
    return compared


def prune(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Positions of the pairs (left, right) of signature rows that survive every step."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for done in range(0, VALUES, STEP):
        matches = matches + (sigs[left[alive], done : done + STEP] == sigs[right[alive], done : done + STEP]).sum(axis=1)
        ok = matches >= fewest_matches(done + STEP, threshold, tolerance)
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sorted arrays."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    used = np.unique(np.concatenate([left, right]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, term, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = times[term] > 1  # a shingle of one set alone is in no intersection
    owner, term = owner[shared], np.unique(term[shared], return_inverse=True)[1]
    out = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    for low in range(0, int(term[-1]) + 1 if len(term) else 0, 4096):
        some = slice(*np.searchsorted(term, (low, low + 4096)))
        held = np.zeros((len(used), 4096), np.float32)
        held[owner[some], term[some] - low] = 1
        out += held @ held.T
    return out[place[left], place[right]].astype(np.int64)


def _described(docs: DataFrame, text: str) -> DataFrame:
    """(row, text_hash, set_hash, n, sig) of each row; n is 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row, missing, data in zip(batch.column(0), batch.column(1).is_null(), byte_values(batch.column(1)), strict=True):
                shingles = np.unique(shingle_hashes(known.of(words(data)), SHINGLE))
                own = b"null %d" % row.as_py() if missing.as_py() else None  # a missing text is a copy of nothing
                out[0].append(xxhash.xxh3_128_digest(own or data, seed=1 if own else 0))
                out[1].append(xxhash.xxh3_128_digest(shingles.tobytes()))
                out[2].append(len(shingles))
                out[3].append(minhash(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], [ROW, "text_hash", "set_hash", "n", "sig"])

    return docs.select(ROW, text).mapInArrow(run, f"{ROW} long, text_hash binary, set_hash binary, n int, sig binary")


def first_of(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` places the least one that it is linked with, directly or not."""
    first = np.arange(count)
    while True:
        a, b = first[left], first[right]
        if (a == b).all():
            return first
        np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
        while (first != first[first]).any():
            first = first[first]


def _band_numbers(sigs: np.ndarray) -> np.ndarray:
    """Numbers (sets, BANDS) that are equal where bands are."""
    bands = sigs.view(np.dtype((np.void, 4 * BAND_ROWS))).reshape(len(sigs), BANDS)
    return np.stack([np.unique(bands[:, k], return_inverse=True)[1].reshape(-1) for k in range(BANDS)], axis=1)


def _alike_in_size(size: np.ndarray, one: np.ndarray, two: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether the sizes of each pair permit the similarity, which cannot exceed their ratio."""
    small, large = np.minimum(size[one][:, None], size[two][None, :]), np.maximum(size[one][:, None], size[two][None, :])
    return small * least.denominator >= large * least.numerator


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.uint32) for x in column])


def _survivors(sets: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(u, v): a forest of the pairs of sets that share a band and survive the pruning.

    A bucket of more than ``block`` sets is cut into blocks. A pair is compared in the first of
    the bands that it shares.
    """
    least = Fraction(str(threshold))
    numbered = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * 4 * BAND_ROWS + 1, F.lit(4 * BAND_ROWS))))).alias("band", "bucket")
    bands = sets.select(ROW, numbered)
    # written, so that the join may split the sets of a large bucket
    shared = materialise(bands.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("held")).where("held > 1").select("bucket", "blocks"), "buckets")
    dealt = bands.join(shared, "bucket").withColumn("b", F.pmod(F.xxhash64(ROW, "bucket"), F.col("blocks")).cast("int"))
    members = dealt.join(sets.select(ROW, "n", "sig"), ROW).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("bucket", "band", "b", ROW, "n", "sig", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
        table = table.sort_by(ROW)
        rows, at, size = table[ROW].to_numpy(), table["b"].to_numpy(), table["n"].to_numpy()
        sigs = _signatures(table["sig"])
        one, two = np.flatnonzero(at == i), np.flatnonzero(at == j)
        meet = _alike_in_size(size, one, two, least)
        if i == j:
            meet = np.triu(meet, 1)
        if meet.any():
            numbers = _band_numbers(sigs)
            for k in range(band):
                meet &= numbers[one, k][:, None] != numbers[two, k][None, :]
        left, right = (x[y] for x, y in zip((one, two), np.nonzero(meet), strict=True))
        alive = prune(sigs, left, right, threshold, tolerance)
        first = first_of(len(rows), left[alive], right[alive])
        linked = np.flatnonzero(first != np.arange(len(rows)))
        return pa.table({"u": rows[first[linked]], "v": rows[linked]})

    return members.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long")


def _shingles_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(row, shingles) of the rows in ``wanted``, through a Bloom filter so that other texts stay where they are."""
    held = bloom_of(wanted.select(F.xxhash64(ROW).alias("hash")))
    shared = docs.sparkSession.sparkContext.broadcast((held.bits, held.seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, some = WordHashes(), Bloom(*shared.value)
        for batch in batches:
            batch = batch.filter(pa.array(some.holds(batch.column(1).to_numpy().view(np.uint64))))
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [np.unique(shingle_hashes(known.of(words(data)), SHINGLE)).tobytes() for data in byte_values(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], [ROW, "shingles"])

    return docs.select(ROW, F.xxhash64(ROW).alias("h"), text).mapInArrow(run, f"{ROW} long, shingles binary").join(wanted, ROW)


def _links(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(row, links, root) of each set with links in each pair of blocks; root: the first of those that the links join."""
    least = Fraction(str(threshold))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        table = table.sort_by(ROW)
        rows, block, texts = table[ROW].to_numpy(), table["b"].to_numpy(), table["texts"].to_numpy()
        sigs = _signatures(table["sig"])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        size = np.array([len(x) for x in sets])
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        numbers = _band_numbers(sigs)
        meet = np.zeros((len(one), len(two)), bool)
        for k in range(BANDS):
            meet |= numbers[one, k][:, None] == numbers[two, k][None, :]
        meet &= _alike_in_size(size, one, two, least)
        if i == j:
            meet = np.triu(meet, 1)
        left, right = (x[at] for x, at in zip((one, two), np.nonzero(meet), strict=True))
        alive = prune(sigs, left, right, threshold, tolerance)
        left, right = left[alive], right[alive]
        links = np.zeros(len(rows), np.int64)
        if len(left):
            inter = overlaps(sets, left, right)
            union = size[left] + size[right] - inter
            linked = inter * least.denominator >= union * least.numerator
            left, right = left[linked], right[linked]
            np.add.at(links, left, texts[right])
            np.add.at(links, right, texts[left])
        have = np.flatnonzero(links)
        return pa.table({ROW: rows[have], "links": links[have], "root": rows[first_of(len(rows), left, right)[have]]})

    return members.groupBy("component", "i", "j").applyInArrow(compare, f"{ROW} long, links long, root long")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-7, block: int = 256, block_shingles: int = 1 << 20) -> DataFrame:
    """(row key, key, text_id, class_id, n_links, first) of each row of ``docs``, which has ``ROW``.

    Words are runs of letters, digits and non-ASCII characters with A-Z lowered; shingles five
    words, or all of a text with fewer. text_id: the least key among equal texts. n_links: how
    many other texts have a similarity of at least ``threshold``. class_id: the least key among
    the texts that links join, directly or through others; ``first`` marks one row of each class.
    Texts without words link with nothing but equal texts; a null text is a class of its own;
    empty tables give no rows.

    Two texts meet if they share a band; those that survive the pruning on their MinHash values
    join components, whose sets are compared on their shingles. A component of more than ``block``
    sets or ``block_shingles`` shingles, and a bucket of more than four times ``block`` sets, is cut
    into blocks and each pair of blocks is a task's group, so memory is bounded whatever a group's
    size; nothing is capped or sampled. ``docs`` is read more than once, so its keys must be
    written ones (``keyed_rows``).
    """
    rows = materialise(_described(docs, text), "signatures")
    texts = rows.where("n > 0").groupBy("set_hash", "text_hash").agg(F.min(F.struct(ROW, "n", "sig")).alias("x"))
    sets = materialise(texts.groupBy("set_hash").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("texts")).select("set_hash", "texts", "x.*"), "sets")
    near = materialise(components(_survivors(sets, threshold, tolerance, 4 * block)).select(F.col("node").alias(ROW), F.col("root").alias("component")).join(sets.select(ROW, "n"), ROW), "components")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / block_shingles)).cast("int")
    sizes = materialise(near.groupBy("component").agg(blocks.alias("blocks")), "component-sizes")
    dealt = near.join(sizes, "component").select(ROW, "component", "blocks", F.pmod(F.xxhash64(ROW), F.col("blocks")).cast("int").alias("b"))
    found = _shingles_of(docs, dealt.select(ROW), text).join(dealt, ROW).join(sets.select(ROW, "texts", "sig"), ROW)
    members = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(ROW, "component", "b", "texts", "sig", "shingles", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))
    links = materialise(_links(members, threshold, tolerance), "links")
    roots = components(links.select(F.col(ROW).alias("u"), F.col("root").alias("v")))
    per_set = sets.select("set_hash", "texts", ROW).join(links.groupBy(ROW).agg(F.sum("links").alias("links")), ROW, "left").join(roots.select(F.col("node").alias(ROW), "root"), ROW, "left")
    per_set = per_set.select("set_hash", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"), F.coalesce("root", ROW).alias("root"))
    keys = docs.select(ROW, F.col(key).alias("k"))
    member = rows.where("n > 0").select(ROW, "text_hash", "set_hash").join(per_set, "set_hash").select(ROW, "text_hash", "n_links", "root")
    lone = rows.where("n = 0").select(ROW, "text_hash", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    all_rows = materialise(member.unionByName(lone).join(keys, ROW), "members")
    by_text = all_rows.groupBy("text_hash").agg(F.min("k").alias("text_id"), F.min(ROW).alias("head"), F.first("root").alias("root"))
    # written, as are the classes of texts, so that the joins may split texts and classes of many rows
    by_text = materialise(by_text.withColumn("root", F.coalesce("root", "head")), "texts")
    classes = materialise(by_text.groupBy("root").agg(F.min("text_id").alias("class_id"), F.min("head").alias("first_row")), "classes")
    of_text = materialise(by_text.join(classes, "root").select("text_hash", "text_id", "class_id", "first_row"), "text-classes")
    return all_rows.join(of_text, "text_hash").select(ROW, F.col("k").alias(key), "text_id", "class_id", "n_links", (F.col(ROW) == F.col("first_row")).alias("first"))


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are near or exact copies of another that stays."""
    keyed = keyed_rows(docs)
    gone = jaccard_join(keyed, key, text, **options).where(~F.col("first")).select(ROW)
    return keyed.join(gone, ROW, "left_anti").drop(ROW)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near copies, class of equal texts and number of other texts that it is similar to."""
    docs = keyed_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return jaccard_join(docs).select("doc_id", "class_id", "text_id", "n_links")


OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT text, min(doc_id) AS class_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL GROUP BY text
), s AS (
  SELECT DISTINCT class_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') || ' ' || least(5, len(w)) AS g
  FROM (SELECT class_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM t WHERE len(w) > 0)
), n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
i AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
p AS (
  SELECT x, y FROM i JOIN n p ON p.class_id = x JOIN n q ON q.class_id = y
  WHERE 5 * c >= 4 * (p.n + q.n - c)
), l AS (SELECT x, count(*) AS n_links FROM p GROUP BY x),
reach AS (SELECT class_id AS x, class_id AS y FROM t UNION SELECT r.x, p.y FROM reach r JOIN p ON p.x = r.y),
g AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(g.class_id, d.doc_id) AS class_id, coalesce(t.class_id, d.doc_id) AS text_id, coalesce(l.n_links, 0) AS n_links
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN l ON l.x = t.class_id LEFT JOIN g ON g.x = t.class_id
"""
