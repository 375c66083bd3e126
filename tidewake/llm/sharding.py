"""Minimax contiguous partition of atomic groups into shards (native: DataFrame functions only).

Copies of one text form an atomic group. Groups stand in the order of a 64-bit hash of their
text, so a range of hashes is a contiguous run of groups and needs no global sort. A histogram
over leading hash bits gives bounds on where each cut of a greedy check may fall; only the
ranges that matter are counted again with more bits, until the smallest feasible capacity and
its cuts are exact. The driver holds histogram bars, never groups or documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.common import materialise

LOWEST = -(1 << 63)


class Bars:
    """Consecutive hash ranges with their bytes; ``whole`` marks bars that hold a single group."""

    def __init__(self, lows: np.ndarray, weights: np.ndarray, whole: np.ndarray):
        self.lows, self.whole = lows, whole
        self.ends = np.concatenate([[0], np.cumsum(weights)])
        self.total = int(self.ends[-1])

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Least and greatest byte position of each greedy cut at this capacity."""
        low = high = 0
        lows, highs = [], []
        for _ in range(shards):
            low = int(self.ends[np.searchsorted(self.ends, low + capacity, "right") - 1])
            aim = high + capacity
            at = int(np.searchsorted(self.ends, aim, "right")) - 1
            high = self.total if at >= len(self.whole) else int(self.ends[at]) if self.whole[at] else aim
            lows.append(low)
            highs.append(high)
        return lows, highs

    def least(self, shards: int, surely: bool, heaviest: int) -> int:
        """Smallest capacity, no group being heavier, that surely (or possibly) suffices, by binary search."""
        low, high = max(1, heaviest, -(-self.total // shards)), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            lows, highs = self.cuts(mid, shards)
            if (lows if surely else highs)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def _bars(rows: DataFrame, bits: int) -> list:
    return rows.groupBy(F.shiftright("h", 64 - bits).alias("bar")).agg(F.sum("size").alias("w"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()


def minimax_cuts(rows: DataFrame, shards: int, first_bits: int = 12, step_bits: int = 6) -> tuple[int, list[int]]:
    """(capacity, for each cut the first hash of the next shard) for ``rows`` (h, size).

    Rows of one hash are a group that no cut divides, however heavy. The capacity is the least with
    which a greedy pass over the groups needs no more than ``shards``.
    """
    heaviest = rows.groupBy("h").agg(F.sum("size").alias("w")).agg(F.max("w")).first()[0] or 0
    found = {(r.lo, r.hi): r.w for r in _bars(rows, first_bits)}
    bits = first_bits
    while True:
        keys = sorted(found)
        bars = Bars(np.array([k[0] for k in keys], np.int64), np.array([found[k] for k in keys], np.int64), np.array([k[0] == k[1] for k in keys], bool))
        possible, sure = bars.least(shards, False, heaviest), bars.least(shards, True, heaviest)
        lows, highs = bars.cuts(possible, shards)[0], bars.cuts(sure, shards)[1]
        spans: list[list[int]] = []  # one for each cut whose place is open, merged where they meet
        for low, high in zip(lows, highs, strict=True):
            first = int(np.searchsorted(bars.ends, low, "right")) - 1
            last = min(int(np.searchsorted(bars.ends, high, "left")), len(keys)) - 1
            if first <= last and not bars.whole[first : last + 1].all():
                if spans and first <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], last)
                else:
                    spans.append([first, last])
        if not spans or (possible == sure and lows == highs):
            ends = bars.cuts(sure, shards)[0]
            cuts = sorted({int(bars.lows[np.searchsorted(bars.ends, x, "left")]) for x in ends if x < bars.total})
            if ends[-1] < bars.total or len(cuts) >= shards:
                raise RuntimeError(f"{len(cuts) + 1} shards of {sure} bytes do not hold all groups")
            return sure, cuts
        bits = min(64, bits + step_bits)
        ranges = [(keys[first][0], keys[last][1]) for first, last in spans]
        for first, last in spans:
            for k in range(first, last + 1):
                found.pop(keys[k])
        inside = F.lit(False)
        for lo, hi in ranges:
            inside = inside | F.col("h").between(lo, hi)
        found |= {(r.lo, r.hi): r.w for r in _bars(rows.where(inside), bits)}


def shard_of(h: Column, cuts: list[int]) -> Column:
    """Shard of a hash: the number of cuts at or below it."""
    return sum(((h >= F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", cells: int = 1024) -> DataFrame:
    """Put every row of ``docs`` into a shard so that the fullest shard is as light as it can be.

    size: UTF-8 bytes of the text plus 16. Equal texts share a shard, null being one text of no
    bytes and apart from the empty one. Shards are contiguous in the order of the groups and
    numbered below ``shards``; the fullest is as light as it can be, and no lighter than the
    heaviest group. ``slot`` numbers the rows of a shard from 0 without gaps. Repeated rows and null keys each keep a slot; an empty
    table gives no rows; other columns are ignored.

    Rows are numbered in ``cells`` parts of a shard, dealt by key and text hash, so a shard of
    one hot group still spreads over many tasks.
    """
    value = F.col(text)
    light = docs.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 16).cast("long").alias("size"),
        F.when(value.isNotNull(), F.crc32(value.cast("binary"))).otherwise(F.crc32(F.lit(b""))).cast("long").alias("crc"),
        F.xxhash64(value).alias("h"),
    )
    light = materialise(light.withColumn("cell", F.pmod(F.xxhash64("k", "h"), F.lit(cells)).cast("int")), "shard-rows")
    _, cuts = minimax_cuts(light.select("h", "size"), shards)
    dealt = light.withColumn("shard", shard_of(F.col("h"), cuts))
    # at most shards * cells rows, whatever the number of documents: safe to broadcast
    counts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("k", "h")
    return (
        dealt.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "cell"])
        .select(
            F.col("k").alias(key),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("n") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
