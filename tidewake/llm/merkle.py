"""Merkle manifest of a table: a tree over the rows of each group, a tree over the groups, a proof for each row.

Leaves stand in one global order, cut into leaf partitions of consecutive leaves. A partition holds
the leaves between two places, so what it lacks on each level of a tree is at most a strip of
siblings on either side: the minimal set of nodes from which all its proofs follow. Those strips
are fetched once for a partition; every node between them is derived there, and the single proofs
are cut from the runs of nodes that are then at hand.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import ascii_lower, crc_mod, global_order, materialise
from tidewake.llm.duck import CRC32

FANOUT = 16
#: Tree number of the tree over the groups.
TOP = -1

PROOF = "array<struct<left: string, right: string>>"


def field_text(column: Column) -> Column:
    """A value's part of a leaf: ``-`` for null, else its UTF-8 byte count, a colon, and itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of the fields' parts in their order."""
    return F.sha2(F.concat(*map(field_text, columns)), 256)


def tree_levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, pos, n, hash), n being a tree's nodes on the level, up to a single node for each tree.

    Each level is a shuffle of a sixteenth of the rows of the one below; a group has 16 rows at most.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, cur = [], nodes
    while most > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
        up = cur.where("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.first("n").alias("n"), F.sha2(F.array_join(run, ""), 256).alias("hash"))
        cur = materialise(up.select("tree", "pos", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "hash"), "merkle-level")
        levels.append(cur)
        most = -(-most // FANOUT)
    return levels


def _missing(spans: DataFrame) -> DataFrame:
    """(block, tree, level, pos) of the nodes that a block lacks; ``spans``: (block, tree, lo, hi, n), its first and last place in a tree of n."""
    depth = F.expr(f"CAST(ceil(round(ln(n) / ln({FANOUT}), 9)) AS INT)")  # levels with more than one node
    at = spans.where("n > 1").select("*", F.explode(F.sequence(F.lit(0), F.greatest(depth, F.lit(1)) - 1)).alias("level"))
    at = at.withColumns({c: F.expr(f"shiftright({c}, 4 * level)") for c in ("lo", "hi")}).withColumn("n", F.expr("shiftright(n - 1, 4 * level) + 1")).where("n > 1")
    strip = lambda end: F.sequence(F.col(end) - F.col(end) % FANOUT, F.col(end) - F.col(end) % FANOUT + (FANOUT - 1))
    before = F.filter(strip("lo"), lambda x: x < F.col("lo"))
    after = F.filter(strip("hi"), lambda x: (x > F.col("hi")) & (x < F.col("n")))
    return at.select("block", "tree", "level", F.explode(F.concat(before, after)).alias("pos"))


class _Tree:
    """Of one tree, what a block's leaves and the fetched nodes give: its runs of nodes, level by level, and its top node."""

    def __init__(self, tree: int, first: int, hashes: list[str], n: int, fetched: dict[tuple[int, int], dict[int, str]]):
        self.parts: list[tuple[int, list[tuple[str, str]]]] = []  # of each level the first place, and left and right siblings from there
        level = 0
        while n > 1:
            more = fetched.get((tree, level), {})
            first, before = first - first % FANOUT, [more[p] for p in range(first - first % FANOUT, first)]
            hashes = before + hashes
            end = min(n, -(-(first + len(hashes)) // FANOUT) * FANOUT)
            hashes = hashes + [more[p] for p in range(first + len(hashes), end)]
            around, up = [], []
            for k in range(0, len(hashes), FANOUT):
                run = "".join(hashes[k : k + FANOUT])
                around += [(run[:p], run[p + 64 :]) for p in range(0, len(run), 64)]
                up.append(hashlib.sha256(run.encode()).hexdigest())
            self.parts.append((first, around))
            first, hashes, n, level = first // FANOUT, up, -(-n // FANOUT), level + 1
        self.top = hashes[0]

    def path(self, pos: int) -> list[tuple[str, str]]:
        out = []
        for first, around in self.parts:
            out.append(around[pos - first])
            pos //= FANOUT
        return out


def _expand(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
    """The proofs of a block's leaves from them and the nodes that were fetched for it."""
    leaves = leaves.sort_by([("tree", "ascending"), ("pos", "ascending")])
    fetched: dict[tuple[int, int], dict[int, str]] = {}
    for tree, level, pos, value in zip(*(nodes[c].to_pylist() for c in ("at_tree", "at_level", "at_pos", "hash")), strict=True):
        fetched.setdefault((tree, level), {})[pos] = value
    trees, places, hashes, sizes = (leaves[c].to_pylist() for c in ("tree", "pos", "leaf", "n"))
    starts = [k for k in range(len(trees)) if not k or trees[k] != trees[k - 1]] + [len(trees)]
    own = [_Tree(trees[a], places[a], hashes[a:b], sizes[a], fetched) for a, b in zip(starts, starts[1:], strict=False)]
    top = _Tree(TOP, trees[0], [t.top for t in own], leaves["trees"][0].as_py(), fetched)
    left, right, ends, subroots = [], [], [0], []
    for tree, a, b in zip(own, starts, starts[1:], strict=False):
        above = top.path(trees[a])
        for pos in places[a:b]:
            path = tree.path(pos) + above
            left += [x for x, _ in path]
            right += [x for _, x in path]
            ends.append(len(left))
        subroots += [tree.top] * (b - a)
    proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
    kept = leaves.select(["row"])
    return kept.append_column("subroot", pa.array(subroots, pa.string())).append_column("root", pa.array([top.top] * len(trees), pa.string())).append_column("proof", proof)


def manifest(leaves: DataFrame, group: str, key: str, leaf: str = "leaf", leaves_per_block: int = 4096) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof``: left and right siblings on each level, up to the root.

    A group's leaves stand by ``key``, nulls first, then by ``leaf``; every 16 consecutive nodes (the
    last run: fewer, even one) become the SHA-256 of their joined hex digests, until one is left, its
    subroot. Subroots stand by ``group``, nulls first, and give the root in the same way. Equal rows
    are leaves of their own; an empty table gives no rows. All columns are kept.

    A block of consecutive leaves is one call's work; it fetches at most 30 nodes for each level
    of the trees at its ends and of the tree over the groups, and no group of rows is larger.
    """
    lowest = lambda c: F.col(c).asc_nulls_first()
    rows = leaves.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(leaf).alias("leaf"), F.struct("*").alias("row"), F.monotonically_increasing_id().alias("tie"))
    placed = global_order(materialise(rows, "merkle-leaves"), [lowest("group"), lowest("key"), F.col("leaf"), F.col("tie")], "__g")
    trees = placed.groupBy(F.col("group").alias("__group")).agg(F.count(F.lit(1)).alias("n"), F.min("__g").alias("__start"))
    trees = materialise(global_order(trees, [F.col("__start")], "tree"), "merkle-trees")
    count = trees.count()
    placed = (
        placed.join(trees, F.col("group").eqNullSafe(F.col("__group")))
        .withColumns({"pos": F.col("__g") - F.col("__start"), "block": F.expr(f"__g div {leaves_per_block}"), "trees": F.lit(count).cast("long")})
        .drop("__group", "__start")
    )
    first = placed.select("tree", "pos", "n", F.col("leaf").alias("hash"))
    levels = tree_levels(first)
    alone = [first, *levels]
    subroots = alone[0].where("n = 1")
    for level in alone[1:]:
        subroots = subroots.unionByName(level.where("n = 1"))
    subroots = materialise(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "hash"), "merkle-subroots")
    edge = F.expr(f"__g % {leaves_per_block}")
    # siblings of a block's leaves in other blocks stand next to a block's ends
    known = placed.where((edge < FANOUT) | (edge >= leaves_per_block - FANOUT)).select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("hash"))
    for k, level in enumerate(levels):
        known = known.unionByName(level.select("tree", F.lit(k + 1).alias("level"), "pos", "hash"))
    for k, level in enumerate([subroots, *tree_levels(subroots)]):
        known = known.unionByName(level.select("tree", F.lit(k).alias("level"), "pos", "hash"))
    spans = placed.groupBy("block", "tree").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("n").alias("n"))
    over = spans.groupBy("block").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).select("block", F.lit(TOP).cast("long").alias("tree"), "lo", "hi", F.lit(count).cast("long").alias("n"))
    fetched = _missing(spans.unionByName(over)).join(known, ["tree", "level", "pos"])
    fetched = fetched.select(*(F.col(c).alias(f"at_{c}") for c in ("block", "tree", "level", "pos")), "hash")
    given = placed.select("block", "tree", "pos", "n", "trees", "leaf", "row")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, subroot string, root string, proof {PROOF}"
    return given.groupBy("block").cogroup(fetched.groupBy("at_block")).applyInArrow(_expand, schema).select("row.*", "subroot", "root", "proof")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf for each document, proofs of all, and what they say of a table in which some texts were lower-cased.

    A null doc_id counts as not tampered with; rows of equal doc_id stand by their leaf.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    leaves = docs.select("doc_id", "source", fields(F.col("text")).alias("leaf"), F.when(crc_mod(F.col("doc_id"), 5) == 0, fields(ascii_lower(F.col("text")))).alias("forged"))
    proven = manifest(leaves, "source", "doc_id")
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("forged", "leaf"), F.col("proof"))
    out = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op13_sql(levels: int = 6) -> str:
    """DuckDB's form, with so many levels below the subroots and above them."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [
        f"d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf('text')} AS leaf, CASE WHEN {CRC32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS forged FROM documents)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS own, forged AS folded, '' AS proof FROM d)",
        "l0 AS (SELECT tree, pos, own AS hash, count(*) OVER (PARTITION BY tree) AS n FROM p0)",
    ]
    # a level: runs of the nodes, each row's siblings in its run, and the next nodes
    step = """r{k} AS (SELECT tree, pos // 16 AS pos, string_agg(hash, '' ORDER BY pos) AS run, any_value(n) AS n FROM l{k} GROUP BY 1, 2),
l{m} AS (SELECT tree, pos, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS hash, (n + 15) // 16 AS n FROM r{k}),
p{m} AS (SELECT p.* REPLACE (p.pos // 16 AS pos, CASE WHEN n = 1 THEN folded ELSE sha256(run[:p.pos % 16 * 64] || folded || run[p.pos % 16 * 64 + 65:]) END AS folded,
  CASE WHEN n = 1 THEN proof ELSE proof || run[:p.pos % 16 * 64] || run[p.pos % 16 * 64 + 65:] END AS proof) FROM p{k} p JOIN r{k} r ON r.tree = p.tree AND r.pos = p.pos // 16)"""
    parts += [step.format(k=k, m=k + 1) for k in range(levels)]
    last = levels + 1
    parts += [
        f"s AS (SELECT tree, hash AS subroot FROM l{levels})",
        f"l{last} AS (SELECT 0 AS tree, tree AS pos, subroot AS hash, count(*) OVER () AS n FROM s)",
        f"p{last} AS (SELECT p.* REPLACE (0 AS tree, p.tree AS pos), subroot FROM p{levels} p JOIN s USING (tree))",
    ]
    parts += [step.format(k=k, m=k + 1) for k in range(last, last + levels)]
    end = last + levels
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, l.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = l.hash AS verified FROM p{end}, l{end} l"


OP13_SQL = _op13_sql()
