"""Removal of repeated passages, found by recompression.

A text's words become names, and rounds shorten the sequence: runs of one name get a name of their
own, then each name falls on a left or a right side by its hash, and every left name followed by a
right one becomes one name. A name is a hash of what it stands for, so it is the same wherever a
task meets it, and rounds need no exchange. With each symbol goes the span of words that its making
looked at: wherever those words stand, the same symbol stands in them.

A window of words takes as its anchor the least of the highest symbols whose spans lie inside it, so
equal windows have equal anchors at equal places. Only anchors that occur more than once are looked
at again: stretches of windows around an anchor are compared as wholes, and window by window where
an anchor stands in different surroundings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Bloom, WordHashes, arrow_rows, bloom_of, byte_values, materialise, mixed

WIDTH = 20
ROUNDS = 2  # a symbol's span after more rounds seldom fits into 20 words
STRETCH = 1 << 16  # words that are compressed at a time
WORDS = 1 << 16  # whose hashes a task holds
ROWS = 1024  # texts that a task holds at a time
SLICE = 1 << 22  # bytes that are split into words at a time
SPACE = b" \t\n\x0b\x0c\r"

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slices(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of some MB that end between words."""
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end]
        at = end


class Symbols:
    """Symbols of some stretches of words: names, and the spans [lo, hi) of words that decide them.

    Both ends of spans rise along the symbols. A symbol whose making looked past the end of its
    stretch has a span that reaches over it, and so lies in no window.
    """

    def __init__(self, names: np.ndarray, part: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.names, self.part = names, part
        self.lo = np.arange(len(names), dtype=np.int64)
        self.hi = self.lo + 1
        self.before, self.after = first - 1, last + 1  # what stands for the spans beyond a stretch

    def _made(self, names: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Symbols:
        out = object.__new__(Symbols)
        out.names, out.part, out.lo, out.hi, out.before, out.after = names, part, lo, hi, self.before, self.after
        return out

    def runs(self) -> Symbols:
        """Each run of equal names becomes one symbol, decided by the names on both sides of it."""
        n, part = len(self.names), self.part
        begin = np.flatnonzero(np.concatenate([[True], (self.names[1:] != self.names[:-1]) | (part[1:] != part[:-1])]))
        end = np.append(begin[1:], n)
        names, own, count = self.names[begin], part[begin], end - begin
        many = count > 1
        names[many] = mixed(names[many] * np.uint64(0xD6E8FEB86659FD93) + count[many].astype(np.uint64))
        lo, hi = self.before[own], self.after[own]
        has = (begin > 0) & (part[begin - 1] == own)
        lo[has] = self.lo[begin[has] - 1]
        has = (end < n) & (part[np.minimum(end, n - 1)] == own)
        hi[has] = self.hi[end[has]]
        return self._made(names, own, lo, hi)

    def pairs(self, turn: int) -> Symbols:
        """Each left name followed by a right one becomes one symbol; a name left alone is decided by the one that did not fit."""
        left = (mixed(self.names + np.uint64(turn * 0xA24BAED4963EE407 % (1 << 64))) & np.uint64(1)).astype(bool)
        follows = np.concatenate([self.part[1:] == self.part[:-1], [False]])
        pair = follows & left & ~np.concatenate([left[1:], [True]])
        second = np.concatenate([[False], pair[:-1]])
        names, lo, hi = self.names.copy(), self.lo.copy(), self.hi.copy()
        at = np.flatnonzero(pair)
        names[at] = mixed(self.names[at] * np.uint64(0xFF51AFD7ED558CCD) + self.names[at + 1] * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(1))
        at = np.flatnonzero(left & follows)
        hi[at] = self.hi[at + 1]
        at = np.flatnonzero(left & ~follows)
        hi[at] = self.after[self.part[at]]
        preceded = np.concatenate([[False], follows[:-1]])
        at = np.flatnonzero(~left & ~second & preceded)
        lo[at] = self.lo[at - 1]
        at = np.flatnonzero(~left & ~preceded)
        lo[at] = self.before[self.part[at]]
        keep = ~second
        return self._made(names[keep], self.part[keep], lo[keep], hi[keep])


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the least value in each range, the first of equal ones; ranges are not empty."""
    best = [np.arange(len(values))]
    widest = int((end - begin).max(initial=1))
    step = 1
    while 2 * step <= widest:
        last = best[-1]
        a, b = last[: len(last) - step], last[step:]
        best.append(np.where(values[a] <= values[b], a, b))
        step *= 2
    level = np.frexp((end - begin).astype(np.float64))[1] - 1  # of 2 ** level <= length
    out = np.empty(len(begin), np.int64)
    for k, table in enumerate(best):
        at = np.flatnonzero(level == k)
        a, b = table[begin[at]], table[end[at] - (1 << k)]
        out[at] = np.where(values[a] <= values[b], a, b)
    return out


class Passages:
    """Of some stretches of words: windows, and groups of consecutive windows that share an anchor.

    A group has the key of its anchor, a signature of all words of its windows, its first window and
    their number.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, width: int):
        ends = np.cumsum(lengths)
        part = np.repeat(np.arange(len(lengths)), lengths)
        self.windows = np.flatnonzero(np.arange(len(words)) + width <= ends[part])
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _B)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:-1])])
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _B_INVERSE)]))
        content = lambda a, b: mixed((sums[b] - sums[a]) * inverse[a])
        levels = [Symbols(words, part, ends - lengths, ends)]
        for turn in range(ROUNDS):
            levels.append(levels[-1].runs().pairs(turn))
        # from the highest level down, each window that has none yet takes the least symbol inside it
        at, key = np.full(len(self.windows), -1), np.zeros(len(self.windows), np.uint64)
        for level in range(ROUNDS, -1, -1):
            open_ = np.flatnonzero(at < 0)
            if not len(open_):
                break
            s, w = levels[level], self.windows[open_]
            begin, end = np.searchsorted(s.lo, w, "left"), np.searchsorted(s.hi, w + width, "right")
            has = begin < end
            open_, begin, end = open_[has], begin[has], end[has]
            if len(open_):
                found = _least(mixed(s.names), begin, end)
                at[open_] = s.lo[found] * (ROUNDS + 1) + level
                key[open_] = mixed(s.names[found] + content(s.lo[found], s.hi[found]) * np.uint64(2 * level + 3))
        own = part[self.windows]
        self.begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (key[1:] != key[:-1]) | (own[1:] != own[:-1])])) if len(at) else np.empty(0, np.int64)
        self.count = np.diff(np.append(self.begin, len(at)))
        first = self.windows[self.begin]
        self.first, self.part, self.key = first, own[self.begin], key[self.begin]
        self.signature = mixed(content(first, first + self.count + (width - 1)) + self.count.astype(np.uint64))
        self.of_window = content(self.windows, self.windows + width)


def _stretches(texts: pa.Array, seen: WordHashes, width: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words' hashes, lengths, rows, places) of stretches, a few at a time; those of one text overlap so that each window is in one of them."""
    parts, rows, places, total = [], [], [], 0

    def held():
        return np.concatenate(parts), np.array([len(x) for x in parts]), np.array(rows), np.array(places)

    for row, data in enumerate(byte_values(texts)):
        hashes = [seen.of(piece.split()) for piece in slices(data)]
        hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        for at in range(0, max(0, len(hashes) - width + 1), stretch):
            part = hashes[at : at + stretch + width - 1]
            parts.append(part)
            rows.append(row)
            places.append(at)
            total += len(part)
            if total >= stretch:
                yield held()
                parts, rows, places, total = [], [], [], 0
    if parts:
        yield held()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(width: int, stretch: int = STRETCH) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Key and signature of every group of windows, and its row's rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes(WORDS)
        for batch in batches:
            for words, lengths, rows, _ in _stretches(batch["text"], seen, width, stretch):
                p = Passages(words, lengths, width)
                yield pa.RecordBatch.from_arrays([_signed(p.key), _signed(p.signature), batch["rank"].take(pa.array(rows[p.part]))], ["key", "signature", "rank"])
            pa.default_memory_pool().release_unused()

    return run


def _again(rows: np.ndarray, keys: np.ndarray, values: np.ndarray, earlier: set[tuple[int, int, int]]) -> np.ndarray:
    """Whether (row, key, value) has come before; ``earlier`` holds those of texts that go on in later stretches."""
    both = np.stack([rows.astype(np.uint64), keys, values], 1)
    _, first, which = np.unique(both, axis=0, return_index=True, return_inverse=True)
    out = first[which.reshape(-1)] != np.arange(len(both))
    if earlier:
        out |= np.fromiter((tuple(x) in earlier for x in both.tolist()), bool, len(both))
    return out


GROUP = "rank {0}, text_hash long, key long, start int, n int, stale array<int>, signature long, windows array<long>"


def _lists(values: np.ndarray, ends: np.ndarray, some: np.ndarray) -> pa.Array:
    """Lists of the values up to each end, null where ``some`` is false; the values of those lists only."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([~some, [False]])), values)


def _candidates(width: int, stretch: int, held: Bloom, divided: Bloom) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups of windows whose key may have come more than once; ``stale``: windows that stood earlier in the same text, if any.

    Signature and windows are given for keys that may have several signatures, unless all windows are stale.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes(WORDS)
        for batch in batches:
            earlier: set[tuple[int, int, int]] = set()
            for words, lengths, rows, places in _stretches(batch["text"], seen, width, stretch):
                p = Passages(words, lengths, width)
                groups = np.flatnonzero(held.holds(p.key)) if len(p.key) else np.empty(0, np.int64)
                if not len(groups):
                    continue
                count = p.count[groups]
                ends = np.cumsum(count)
                within = np.arange(ends[-1]) - np.repeat(ends - count, count)
                row, of_group = rows[p.part[groups]], np.repeat(np.arange(len(groups)), count)
                values = p.of_window[np.repeat(p.begin[groups], count) + within]
                again = _again(row[of_group], p.key[groups][of_group], values, earlier)
                if places[-1] or lengths[-1] > stretch:  # the last text is longer than a stretch
                    last = row[of_group] == rows[-1]
                    earlier = {x for x in earlier if x[0] == rows[-1]} | set(map(tuple, np.stack([row[of_group].astype(np.uint64), p.key[groups][of_group], values], 1)[last].tolist()))
                stale = np.bincount(of_group[again], minlength=len(groups))
                several = divided.holds(p.key[groups]) & (stale < count)
                starts = p.first[groups] - (np.cumsum(lengths) - lengths)[p.part[groups]] + places[p.part[groups]]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["rank"].take(take), batch["text_hash"].take(take), _signed(p.key[groups]), pa.array(starts.astype(np.int32)), pa.array(count.astype(np.int32)),
                        _lists(pa.array(within[again].astype(np.int32)), np.cumsum(stale), stale > 0),
                        pa.array(p.signature[groups].view(np.int64), mask=~several), _lists(_signed(values[several[of_group]]), np.cumsum(count * several), several),
                    ],
                    ["rank", "text_hash", "key", "start", "n", "stale", "signature", "windows"],
                )
            pa.default_memory_pool().release_unused()

    return run


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, stretch: int = STRETCH) -> DataFrame:
    """(rank, text_hash, gone): of each text with any, stretches of windows, by start and number, whose words also start earlier.

    Earlier means in a row of smaller ``key`` (a null one is smaller than all, and its rank null), or
    earlier in the same text. Rows of equal key do not come before each other. Words are what white
    space of ASCII separates, unchanged. Anchors are aggregated before they are shuffled, so one that
    stands in very many rows is few rows, and the joins can be split.
    """
    given = docs.select(F.col(key).alias("rank"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = given.schema["rank"].dataType.simpleString()
    lowest = [F.min("rank").alias("first"), F.max(F.col("rank").isNull()).alias("first_null")]
    later = F.coalesce((F.col("rank") > F.col("first")) | (F.col("first_null") & F.col("rank").isNotNull()), F.lit(False))
    interval = lambda start, n: F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"))
    whole = F.array(interval(F.col("start"), F.col("n")))
    stale = F.transform(F.coalesce("stale", F.array().cast("array<int>")), lambda k: interval(F.col("start") + k, F.lit(1)))

    anchors = given.select("rank", "text").mapInArrow(_anchors(width, stretch), f"key long, signature long, rank {kind}")
    common = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("signature").alias("a"), F.max("signature").alias("b"), *lowest).where("times > 1")
    with arrow_rows(docs.sparkSession, ROWS):
        common = materialise(common.select("key", (F.col("a") != F.col("b")).alias("several"), "first", "first_null"), "repeat-keys")
    held, divided = (bloom_of(x.select(F.col("key").alias("hash"))) for x in (common, common.where("several")))
    groups = given.mapInArrow(_candidates(width, stretch, held, divided), GROUP.format(kind)).join(common, "key")
    # a key with one signature is settled at once, as are windows of the same text; the others keep what tells their windows apart
    settled = F.when(F.size("stale") == F.col("n"), whole).when(~F.col("several"), F.when(later, whole).otherwise(stale))
    open_ = F.col("several") & F.col("windows").isNotNull()
    groups = groups.select("rank", "text_hash", F.when(~open_, settled).alias("gone"), *(F.when(open_, F.col(c)).alias(c) for c in ("key", "signature", "start", "n", "stale", "windows"))).where("key is not null or size(gone) > 0")
    with arrow_rows(docs.sparkSession, ROWS):
        groups = materialise(groups, "repeat-groups")
    divided_rows = groups.where("key is not null").drop("gone")
    # the lowest rows are written, or moved under another key: only a join of two shuffles can split a key of very many rows
    lowest_rows = materialise(divided_rows.groupBy("key", "signature").agg(*lowest), "repeat-signatures")
    marked = divided_rows.join(lowest_rows, ["key", "signature"]).withColumn("later", later).drop("first", "first_null")
    # of the first row with a signature: the windows that another signature has in an earlier row
    windows = marked.where("not later").select("rank", "text_hash", F.posexplode("windows").alias("at", "window"), "key", "start")
    moved = windows.groupBy("key", "window").agg(*lowest).select(F.xxhash64("key", "window").alias("both"), F.col("key").alias("k"), F.col("window").alias("w"), "first", "first_null")
    single = windows.withColumn("both", F.xxhash64("key", "window")).join(moved, "both").where("key = k and window = w").where(later)
    found = groups.where("size(gone) > 0").select("rank", "text_hash", "gone")
    found = found.unionByName(marked.select("rank", "text_hash", F.when(F.col("later"), whole).otherwise(stale).alias("gone")).where("size(gone) > 0"))
    found = found.unionByName(single.select("rank", "text_hash", F.array(interval(F.col("start") + F.col("at"), F.lit(1))).alias("gone")))
    return found.groupBy("rank", "text_hash").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def _keep(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            kept, total, removed = [], [], []
            for data, gone in zip(byte_values(batch["text"]), batch["gone"], strict=True):
                out, n, lost = [], 0, 0
                starts = counts = np.empty(0, np.int64)
                if gone.is_valid:
                    starts, counts = (gone.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                for piece in slices(data):
                    found = piece.split()
                    if len(starts):
                        # covered words: +1 where a stretch begins, -1 behind its last window's last word
                        edge = np.zeros(len(found) + 1, np.int64)
                        np.add.at(edge, np.clip(starts - n, 0, len(found)), 1)
                        np.add.at(edge, np.clip(starts + counts + (width - 1) - n, 0, len(found)), -1)
                        stays = np.cumsum(edge)[:-1] == 0
                        lost += len(found) - int(stays.sum())
                        out += [w for w, s in zip(found, stays.tolist(), strict=True) if s]
                    else:
                        out += found
                    n += len(found)
                kept.append(b" ".join(out))
                total.append(n)
                removed.append(lost)
            text = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["row"], text, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["row", "kept", "n_words", "n_removed"])
            pa.default_memory_pool().release_unused()

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, stretch: int = STRETCH) -> DataFrame:
    """``docs`` with kept_text, kept_words and removed_words: every word covered by a window of ``width`` words that also starts earlier is gone.

    Windows are judged on the input. Kept words are joined by one space. Null and empty texts have no
    words; texts of fewer words than a window keep all. See ``repeated_passages`` for null and repeated keys.
    """
    gone = materialise(repeated_passages(docs, key, text, width, stretch), "repeat-gone").withColumnsRenamed({"rank": "__rank", "text_hash": "__hash"})
    held = bloom_of(gone.select(F.col("__hash").alias("hash")))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("rank"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # texts that keep all are not shuffled; Spark looks them up, as a UDF beside ``_keep`` would double the Python workers
    filter_, may = F.broadcast(held.row(docs.sparkSession)), held.holds_column("text_hash")
    whole = rows.join(filter_, may, "left_anti").select("row", "text", F.lit(None).cast("array<struct<start: int, n: int>>").alias("gone"))
    cut = rows.join(filter_, may, "left_semi").join(gone, F.col("rank").eqNullSafe(F.col("__rank")) & (F.col("text_hash") == F.col("__hash")), "left").select("row", "text", "gone")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, kept string, n_words long, n_removed long"
    return whole.unionByName(cut).mapInArrow(_keep(width), schema).select("row.*", F.col("kept").alias("kept_text"), F.col("n_words").alias("kept_words"), F.col("n_removed").alias("removed_words"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words removed from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", F.col("kept_words").alias("n_words"), F.col("removed_words").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
x AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM x),
g AS (SELECT DISTINCT doc_id, i + j AS place FROM f, range(20) t(j) WHERE again),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM w ANTI JOIN g USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
