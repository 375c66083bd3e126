"""Connected components of an edge list by repeated contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import materialise


def _contracted(edges: DataFrame, order: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """(node, root) of every node, root being the first by ``order`` of it and its neighbours; the edges between roots.

    The first neighbour is found by an aggregate that combines before the shuffle, and written, so
    that the joins with it read both sides from a shuffle and the edges of a hub can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min(F.struct(order("v").alias("x"), F.col("v"))).alias("near"))
    own = F.struct(order("u").alias("x"), F.col("u").alias("v"))
    roots = materialise(first.select(F.col("u").alias("node"), F.least("near", own)["v"].alias("root")), "roots")
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    moved = edges.join(at("u"), "u").select(F.col("u_root").alias("u"), "v").join(at("v"), "v").select("u", F.col("v_root").alias("v"))
    rest = moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return roots, materialise(rest, "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, the root being a node of its component.

    ``edges`` has the long columns u and v in either order. Each round replaces every node by the
    first of it and its neighbours, by turns in the order of the keys, which ends stars at once,
    and in a new random order, which shortens long paths by a share; rounds go on until no edge is
    left. Each writes its edges in the shared folder. An empty table gives no rows; loops and
    repeated edges change nothing.
    """
    edges = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty() or not rounds:
        turn = len(rounds)
        roots, edges = _contracted(edges, (lambda c, turn=turn: F.xxhash64(c, F.lit(turn))) if turn % 2 else F.col)
        rounds.append(roots)
    out = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = earlier.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out
