"""Helpers shared by the corpus operators: words, hashes, row keys, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters fold to lower case, ASCII digits stay, every other ASCII byte separates words;
#: bytes above 0x7F belong to words. So ``data.translate(WORD_BYTES).split()`` gives the words
#: that ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` finds in the text with A-Z in lower case.
WORD_BYTES = bytes((b if b > 127 or chr(b).isalnum() else 32) if not 65 <= b <= 90 else b + 32 for b in range(256))

#: Row key that operators add for themselves; it does not clash with a caller's columns.
ROW = "__row_key"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); in local mode, as in tests, a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_tidewake_shared", None)
        if base is None:
            base = spark._tidewake_shared = tempfile.mkdtemp(prefix="spark-tidewake-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidewake-{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts its lineage.

    Files in the shared folder outlive executors, so a lost one costs no recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside hand at most so many rows at a time to Python.

    A batch of whole texts stands in the buffers of both sides at once, for every task of an executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``ROW``, unique for each row, so that repeated rows and null or repeated ids stay apart.

    The values hold within one job only, since they follow the splits of its scan; see ``keyed_rows``.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def keyed_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``ROW``, written once: later jobs read the same keys however they split the input."""
    return materialise(with_row_key(df), "rows")


def global_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the order of ``order`` over the whole table.

    Rows are dealt by ranges of ``order``, so that one frequent value spreads over tasks as long as
    later columns tell its rows apart, and written; only the rows' number in each partition is summed up.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = materialise(dealt.withColumns({"__part": F.spark_partition_id(), "__within": within}), "ordered")
    begin, starts = 0, []
    for part, n in sorted(dealt.groupBy("__part").count().collect()):  # a row for each partition
        starts.append((part, begin))
        begin += n
    starts = spark.createDataFrame(starts, "__part int, __begin long")
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__begin") + F.col("__within")).drop("__part", "__within", "__begin")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or other letters."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def byte_values(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The values of a string column as UTF-8 bytes, a null as empty, one at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def words(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class WordHashes(dict):
    """64-bit hashes of words, computed once each; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish hashes so that all their bits depend on all of the input."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; empty if there are fewer words."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = word_hashes[:count].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += word_hashes[k : k + count]
    return mixed(out * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(n))


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """As ``gram_hashes``, but fewer words than ``n``, if any, make one shingle."""
    return gram_hashes(word_hashes, min(n, len(word_hashes))) if len(word_hashes) else np.empty(0, np.uint64)


class Bloom:
    """A bit set of 2**bits places and two probes for each hash."""

    def __init__(self, bits: int, seen: np.ndarray | None = None):
        self.bits = bits
        self.seen = np.zeros(1 << (bits - 3), np.uint8) if seen is None else seen

    def holds(self, h: np.ndarray) -> np.ndarray:
        one = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        two = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return ((self.seen[one >> 3] >> (one & 7)) & (self.seen[two >> 3] >> (two & 7)) & 1).astype(bool)


    def row(self, spark: SparkSession) -> DataFrame:
        """One row with all places as the binary ``places``, to broadcast."""
        return spark.createDataFrame([(bytearray(self.seen.tobytes()),)], "places binary")

    def holds_column(self, h: str) -> Column:
        """``holds`` for a long column, where ``row`` is joined."""
        held = lambda at: f"(shiftright(cast(conv(hex(substring(places, cast(({at}) div 8 as int) + 1, 1)), 16, 10) as int), cast(({at}) & 7 as int)) & 1)"
        one, two = f"shiftrightunsigned({h}, {64 - self.bits})", f"({h} & {(1 << self.bits) - 1}L)"
        return F.expr(f"{held(one)} & {held(two)} = 1")


def bloom_bits(count: int, most: int = 26) -> int:
    """Bits, as a power of two, for so many hashes: 16 or more for each, up to 2**26 (8 MiB), beyond which more others pass."""
    return min(most, max(16, (16 * count - 1).bit_length()))


def bloom_of(hashes: DataFrame) -> Bloom:
    """The filter of the column ``hash``, put together in tasks as words of 64 places."""
    bits = bloom_bits(hashes.count())
    places = hashes.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND((1 << bits) - 1))).alias("p"))
    held = places.groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    got = held.toArrow()  # at most 2**bits / 64 rows
    out = np.zeros(1 << (bits - 6), "<i8")
    out[got["at"].to_numpy()] = got["b"].to_numpy()
    return Bloom(bits, out.view(np.uint8))
