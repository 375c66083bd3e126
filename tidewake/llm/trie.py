"""Prefix trie of conversations, from adaptive radix trees over fixed-width turn ids.

Each turn is a 16-byte id of its role and text, so a conversation is a key of bytes in which every
16th depth ends a turn. Tasks put the conversations that they hold into adaptive radix trees (node
layouts for 4, 16, 48 and 256 branches, compressed paths) and emit the counts of every turn-aligned
depth; the counts of one prefix, known by a hash of its turns and their places, are added up over
tasks by an aggregate that combines before its shuffle. Long conversations are cut into segments of
a bounded number of turns, each in the tree that hangs at the prefix before it, so neither a common
first turn nor one endless conversation meets in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.common import global_order, materialise
from tidewake.llm.duck import CRC32

WIDTH = 16  # bytes of a turn's id
SEGMENT = 64  # turns of a segment at most
CHUNK = 4096  # ids that are joined into one text before they are hashed

NODE = "z1 long, z2 long, depth long, up1 long, up2 long, n long, least long, bytes long, leaves long, saved long"


class Small:
    """Branches of a node with up to 4 or 16 of them: sorted bytes beside the nodes."""

    __slots__ = ("room", "keys", "kids")

    def __init__(self, room: int = 4, keys: bytes = b"", kids: list | None = None):
        self.room, self.keys, self.kids = room, bytearray(keys), kids or []

    def get(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Small | Indexed:
        """Set a branch; returns the layout that holds it, a larger one where this is full."""
        at = self.keys.find(byte)
        if at >= 0:
            self.kids[at] = node
            return self
        if len(self.kids) == self.room:
            if self.room == 4:
                return Small(16, self.keys, self.kids).put(byte, node)
            larger = Indexed()
            for b, kid in zip(self.keys, self.kids, strict=True):
                larger.put(b, kid)
            return larger.put(byte, node)
        at = sum(b < byte for b in self.keys)
        self.keys.insert(at, byte)
        self.kids.insert(at, node)
        return self


class Indexed:
    """Branches of a node with up to 48 of them: an index of 256 bytes into the nodes."""

    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        if at := self.index[byte]:
            self.kids[at - 1] = node
            return self
        if len(self.kids) == 48:
            return Full(self).put(byte, node)
        self.kids.append(node)
        self.index[byte] = len(self.kids)
        return self


class Full:
    """Branches of a node with more: a place for each byte."""

    __slots__ = ("places",)

    def __init__(self, smaller: Indexed):
        self.places = [smaller.get(b) for b in range(256)]

    @property
    def kids(self) -> list[Node]:
        return [x for x in self.places if x is not None]

    def get(self, byte: int) -> Node | None:
        return self.places[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.places[byte] = node
        return self


class Node:
    """A branching point or the end of a key: the compressed path that leads to it, and what is added up of the keys through it.

    ``way`` is a segment through it, from which the turns on the path are read. ``beyond`` adds up
    what keys that end here save further on.
    """

    __slots__ = ("path", "end", "branches", "way", "n", "least", "owned", "leaves", "beyond")

    def __init__(self, path: bytes, end: int, way: int):
        self.path, self.end, self.way = path, end, way
        self.branches: Small | Indexed | Full = Small()
        self.n, self.least, self.owned, self.leaves, self.beyond = 0, 1 << 62, 1 << 62, 0, 0

    def add(self, conv: int, owned: int, leaf: int) -> None:
        self.n += 1
        self.least, self.owned, self.leaves = min(self.least, conv), min(self.owned, owned), self.leaves + leaf


def insert(root: Node, key: bytes, way: int, conv: int, owned: int, leaf: int, beyond: int) -> None:
    """Add a key whose length is a whole number of turns."""
    node, at = root, 0
    node.add(conv, owned, leaf)
    while at < len(key):
        kid = node.branches.get(key[at])
        if kid is None:
            kid = Node(key[at:], len(key), way)
            node.branches = node.branches.put(key[at], kid)
        elif not key.startswith(kid.path, at):  # the path splits, at the end of this key or before
            same = next((k for k, (a, b) in enumerate(zip(kid.path, key[at:], strict=False)) if a != b), len(key) - at)
            upper = Node(kid.path[:same], at + same, kid.way)
            upper.n, upper.least, upper.owned, upper.leaves = kid.n, kid.least, kid.owned, kid.leaves
            kid.path = kid.path[same:]
            upper.branches = upper.branches.put(kid.path[0], kid)
            node.branches = node.branches.put(key[at], upper)
            kid = upper
        kid.add(conv, owned, leaf)
        node, at = kid, kid.end
    node.beyond += beyond


class Forest:
    """The trees of a task's segments, one for each prefix that segments begin at; emptied once it holds enough turns."""

    def __init__(self, most_turns: int = 100_000):
        self.most, self.turns = most_turns, 0
        self.roots: dict[tuple[int, int, int], Node] = {}
        self.ways: list[tuple[list[int], list[int], list[int]]] = []

    def add(self, conv: int, start: int, z1: int, z2: int, ids: list[bytes], hash1: list[int], hash2: list[int], sizes: list[int], owned: int, leaf: int, beyond: int) -> None:
        root = self.roots.get((start, z1, z2))
        if root is None:
            root = self.roots[start, z1, z2] = Node(b"", 0, len(self.ways))
        insert(root, b"".join(ids), len(self.ways), conv, owned, leaf, beyond)
        self.ways.append((hash1, hash2, sizes))
        self.turns += len(ids) + 1

    def rows(self) -> Iterator[tuple]:
        """Rows of NODE for every turn-aligned depth of every tree, from the ends upwards: sums of a node follow those below it.

        The root of a tree that hangs at a prefix is the last node of the tree before; it is left out.
        """
        for (start, z1, z2), root in self.roots.items():
            down: list[tuple[Node, int, int]] = [(root, z1, z2)]  # every node with the hashes of its end
            for node, a, b in down:
                for kid in node.branches.kids:
                    hash1, hash2, _ = self.ways[kid.way]
                    p, q = a, b
                    for t in range((kid.end - len(kid.path)) // WIDTH, kid.end // WIDTH):
                        p, q = p ^ hash1[t], q ^ hash2[t]
                    down.append((kid, p, q))
            saved: dict[int, int] = {}
            for node, p, q in reversed(down):
                total = node.beyond + sum(saved.pop(id(kid)) for kid in node.branches.kids)
                first = (node.end - len(node.path)) // WIDTH  # the first turn that ends on the path
                hash1, hash2, sizes = self.ways[node.way]
                for t in range(node.end // WIDTH - 1, first - 1, -1):
                    depth = start + t + 1
                    # each of the keys through it saves the turn but one, the owner's, which is told apart by where it begins to own
                    total += sizes[t] * (node.n - (node.owned <= depth))
                    up, vp = p ^ hash1[t], q ^ hash2[t]
                    yield p, q, depth, up, vp, node.n, node.least, sizes[t], node.leaves, total
                    p, q = up, vp
                saved[id(node)] = total
            if start == 0:
                yield z1, z2, 0, None, None, root.n, root.least, 0, root.leaves, saved[id(root)]
        self.roots, self.ways, self.turns = {}, [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in NODE.split(", ")]

    def full(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)

    forest = Forest()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            forest.add(*row)
            if forest.turns >= forest.most:
                yield from full(forest.rows())
    yield from full(forest.rows())


def _merged(segments: DataFrame, least: bool) -> DataFrame:
    """The trees' nodes, added up over tasks: counts and owners, or sums over subtrees."""
    nodes = segments.select("conv", "start", "z1", "z2", "ids", "hash1", "hash2", "sizes", "owned", "leaf", "beyond").mapInArrow(_count, NODE)
    sums = [F.sum("n").alias("n"), F.min("least").alias("least")] if least else [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    return nodes.groupBy("z1", "z2", "depth", "up1", "up2").agg(*sums)


def turn_segments(turns: DataFrame) -> DataFrame:
    """(conv, start, turns' ids, place hashes and sizes, z1, z2): segments, each with the hash of the turns before it.

    ``turns``: (conv, depth from 1, id, size), and a row of depth 0 for each conversation. The hash
    of a prefix is the exclusive or of 128 bits for each turn and its place.
    """
    lanes = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "id", "depth")).otherwise(F.lit(0)) for k in (1, 2)]
    placed = turns.withColumns({"h1": lanes[0], "h2": lanes[1], "start": F.expr(f"(greatest(depth, 1) - 1) div {SEGMENT} * {SEGMENT}")})
    cells = F.array_sort(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "id", "h1", "h2", "size"))))
    segments = placed.groupBy("conv", "start").agg(cells.alias("x"), F.bit_xor("h1").alias("own1"), F.bit_xor("h2").alias("own2"))
    before = Window.partitionBy("conv").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select(
        "conv", "start", F.col("x.id").alias("ids"), F.col("x.h1").alias("hash1"), F.col("x.h2").alias("hash2"), F.col("x.size").alias("sizes"), "own1", "own2",
        F.coalesce(F.bit_xor("own1").over(before), F.lit(0).cast("long")).alias("z1"), F.coalesce(F.bit_xor("own2").over(before), F.lit(0).cast("long")).alias("z2"),
    )


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's chunks, which come in their order; a node's rows follow each other."""
    now, digest, done = None, None, []
    for batch in batches:
        for a, b, depth, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b, depth) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (a, b, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(chunk.encode())
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["z1", "z2", "depth", "ends"])
            done = []
    if now is not None:
        done.append((*now, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["z1", "z2", "depth", "ends"])


NODE_KEY = ["z1", "z2", "depth"]


def _ends(segments: DataFrame) -> DataFrame:
    """(node, digest of the conversations that end at it, in numerical order and joined by commas).

    Ids are joined in parallel, some thousands at a time; what one task hashes in order are those texts.
    """
    last = segments.groupBy("conv").agg(F.bit_xor("own1").alias("z1"), F.bit_xor("own2").alias("z2"), F.max(F.col("start") + F.size("ids")).alias("depth"))
    ordered = global_order(last, [*map(F.col, NODE_KEY), F.col("conv")], "g")
    chunks = ordered.groupBy(*NODE_KEY, F.expr(f"g div {CHUNK}").alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("chunk"))
    lined = chunks.repartition(*NODE_KEY).sortWithinPartitions(*NODE_KEY, "c").select(*NODE_KEY, "chunk")
    return lined.mapInArrow(_ends_hash, "z1 long, z2 long, depth long, ends string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv (long), depth (from 1, gapless; 0 in a row that each conversation has), id (16
    bytes that stand for role and text), size (bytes of the text). ``saved_tokens`` adds up over a
    node's subtree the bytes of its last turn for every member but one. An empty table gives no rows.

    Sums over subtrees need no walk from depth to depth: each conversation adds to the nodes on its
    way what it holds below them, less the turns of the nodes whose smallest member it is. Those are
    its last turns from some depth on, which the first count tells.
    """
    segments = materialise(turn_segments(turns), "trie-segments")
    unknown = F.lit(1 << 62).cast("long")
    flat = segments.withColumns({"owned": unknown, "leaf": F.lit(0).cast("long"), "beyond": F.lit(0).cast("long")})
    nodes = materialise(_merged(flat, True), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up1").alias("z1"), F.col("up2").alias("z2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    counted = materialise(nodes.join(children, NODE_KEY, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))), "trie-counted")
    owners = counted.groupBy(F.col("least").alias("conv")).agg(F.min("depth").alias("owned"), F.max((F.col("children") == 0).cast("long")).alias("leaf"))
    known = segments.join(owners, "conv", "left").withColumns({"owned": F.coalesce("owned", unknown), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    # what a segment's conversation holds in later segments, without what it owns there
    later = Window.partitionBy("conv").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    below = F.aggregate(F.transform("sizes", lambda s, k: F.when(F.col("start") + k + 1 < F.col("owned"), s).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    known = known.withColumn("below", below).withColumn("beyond", F.coalesce(F.sum("below").over(later), F.lit(0).cast("long")))
    sums = _merged(known, False).select(*NODE_KEY, "leaves", "saved", F.lit(None).cast("string").alias("ends"))
    ends = _ends(segments).select(*NODE_KEY, F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("long").alias("saved"), "ends")
    more = sums.unionByName(ends).groupBy(*NODE_KEY).agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"), F.max("ends").alias("ends"))
    up = counted.select(F.col("z1").alias("up1"), F.col("z2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent"))
    return counted.join(more, NODE_KEY).join(up, ["up1", "up2", "depth"], "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, place from 0, id, size, n turns): turns by ``turn``, nulls first, then by their id; null role or text counts as empty.

    Rows without a conv_id belong to no conversation and are left out. Places come from the order of
    the whole table, so one conversation of very many turns is spread over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("id"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("tie")
    )
    ordered = global_order(materialise(one, "turns"), [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("tie")], "g")
    starts = ordered.groupBy("conv").agg(F.min("g").alias("begin"), F.count(F.lit(1)).alias("n"))
    return ordered.join(starts, "conv").select("conv", (F.col("g") - F.col("begin")).alias("place"), "id", "size", "n")


def base_of(conv: Column) -> Column:
    return conv - conv % 5


def borrowed_turns(conv: Column) -> Column:
    """How many of its base's turns a conversation begins with."""
    return F.crc32(conv.cast("string")) % 9


def rebuilt_turns(numbered: DataFrame) -> DataFrame:
    """(conv, depth, id, size) of the rebuilt conversations: first turns of the base, own turns after as many; and a row of depth 0 for each."""
    n = F.max("n").alias("n")
    convs = materialise(numbered.groupBy("conv").agg(n).withColumns({"base": base_of(F.col("conv")), "h": borrowed_turns(F.col("conv"))}), "conversations")
    # a conversation borrows 8 turns at most, so 8 rows of a base serve at most nine conversations around it
    lent = numbered.where((F.col("place") < 8) & (F.col("conv") % 5 == 0)).select(F.col("conv").alias("from"), "place", "id", "size")
    lent = lent.select("*", F.explode(F.sequence(F.col("from") - 4, F.col("from") + 4)).alias("conv")).where((base_of(F.col("conv")) == F.col("from")) & (borrowed_turns(F.col("conv")) > F.col("place")))
    lent = lent.join(convs.select("conv"), "conv", "left_semi").select("conv", (F.col("place") + 1).alias("depth"), "id", "size")
    has = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    shift = convs.join(has, "base", "left").select("conv", "h", (F.least("h", F.coalesce("base_n", F.lit(0))) - F.col("h")).alias("shift"))
    own = numbered.join(shift, "conv").where(F.col("place") >= F.col("h")).select("conv", (F.col("place") + F.col("shift") + 1).alias("depth"), "id", "size")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("size"))
    return lent.unionByName(own).unionByName(roots)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations; a conversation whose conv_id is null is none."""
    return prefix_trie(rebuilt_turns(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT conv_id, 0 AS part, place, t FROM c JOIN (SELECT conv_id AS base, place, t FROM t) b USING (base) WHERE place < h UNION ALL SELECT conv_id, 1, place, t FROM c JOIN t USING (conv_id) WHERE place >= h),
d AS (SELECT conv_id, list(t) OVER w AS key, row_number() OVER w AS depth, last_value(t) OVER w AS t FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)),
e AS (SELECT conv_id, coalesce(max(depth), 0) AS len FROM c LEFT JOIN d USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, key, depth, strlen(t.body) AS size FROM d UNION ALL SELECT conv_id, [] AS key, 0, 0 FROM c),
n AS (SELECT key, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (len = depth), '') AS ends FROM m JOIN e USING (conv_id) GROUP BY key, depth),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.key[:n.depth] = n.key) AS n_children FROM n)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.ends) AS ends_sha256
FROM k LEFT JOIN k p ON p.depth = k.depth - 1 AND p.key = k.key[:p.depth]
JOIN (SELECT a.key, a.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens FROM k a JOIN k b ON b.depth >= a.depth AND b.key[:a.depth] = a.key GROUP BY ALL) s ON s.depth = k.depth AND s.key = k.key"""
