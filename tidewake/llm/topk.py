"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries and candidates are dealt into blocks of fixed size; every pair of blocks is one group.
Within a group each dimension has a list of candidates sorted by value, read from the end that
the query's sign favours. Candidates found within depth t of any list are scored exactly. No
candidate further down can score more than the query's product with the values at depth t, so a
query stops once its kth score beats that bound. Scores are integers and ties go to smaller ids.
How early that is depends on the vectors: with few or unequal dimensions soon, with many equal
ones not before every candidate was met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.common import ROW, keyed_rows

MOST = 1 << 48


def threshold_topk(queries: np.ndarray, own: np.ndarray, items: np.ndarray, k: int, first_depth: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """Best ``k`` items for each query as (scores, item positions); position -1 fills up short rows.

    ``own``: each query's own position among the items, or -1. Ties go to smaller positions. Also
    returns how many scores were computed.
    """
    n, d = items.shape
    k = min(k, n)
    order = np.argsort(items, axis=0, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(n)[:, None], axis=0)
    depth_of = np.minimum(ranks, n - 1 - ranks).min(axis=1)  # where a list, from either end, first shows the item
    values = np.take_along_axis(items, order, axis=0)
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)
    none = np.iinfo(np.int64).min
    best = np.full((len(queries), k), none, np.int64)  # score * n + (n - 1 - position)
    active, done, depth, scored = np.arange(len(queries)), 0, first_depth, 0
    while len(active) and done < n:
        new = np.flatnonzero((depth_of >= done) & (depth_of < depth))
        for part in np.array_split(new, -(-len(new) // 4096)) if len(new) else ():
            for some in np.array_split(active, -(-len(active) // 512)):
                keyed = (queries[some] @ items[part].T).astype(np.int64) * n + (n - 1 - part)
                keyed[own[some][:, None] == part[None, :]] = none
                scored += keyed.size
                both = np.concatenate([best[some], keyed], axis=1)
                best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        if depth * 2 >= n:  # both ends have met: every item was seen
            break
        bound = above[active] @ values[n - 1 - depth] + below[active] @ values[depth]
        worst = best[active].min(axis=1)
        active = active[(worst == none) | (bound >= worst // n)]
        done, depth = depth, depth * 2
    best = -np.sort(-best, axis=1)
    found = best != none
    return np.where(found, best // n, 0), np.where(found, n - 1 - best % n, -1), scored


def exact_topk(vectors: DataFrame, query: Column | None = None, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", query_block: int = 8192, item_block: int = 16384) -> DataFrame:
    """Each query's ``k`` best rows by the inner product of floor(scale * component).

    ``query`` marks the query rows (default: id divisible by 20). Vectors that are null or hold a
    null or non-finite component take no part, neither do rows with a null id; vectors are
    compared with those of their own length. Rows with the same id are queries and candidates of
    their own, and only a row itself is left out. An empty table gives no rows; other columns are
    ignored. Products must stay below 2**48, else the task fails rather than give a rounded score.
    """
    query = F.col(key) % 20 == 0 if query is None else query
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    rows = keyed_rows(usable.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("q")))
    n, nq = rows.select(F.count(F.lit(1)), F.count_if("q")).first()
    item_blocks, query_blocks = max(1, -(-n // item_block)), max(1, -(-nq // query_block))
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    dealt = lambda count: F.pmod(F.xxhash64(ROW), F.lit(count))
    items = rows.select(ROW, "id", "v", F.lit(False).alias("q"), dealt(item_blocks).alias("b"), numbers(query_blocks).alias("a"))
    asked = rows.where("q").select(ROW, "id", "v", "q", numbers(item_blocks).alias("b"), dealt(query_blocks).alias("a"))

    def pair(table: pa.Table) -> pa.Table:
        ids, keys, is_query = table["id"].to_numpy(), table[ROW].to_numpy(), table["q"].to_numpy()
        lengths = np.asarray(table["v"].combine_chunks().value_lengths())
        out = []
        for d in np.unique(lengths[lengths > 0]):
            flat = table["v"].filter(pa.array(lengths == d)).combine_chunks().flatten().to_numpy().reshape(-1, d)
            some, own = np.floor(flat * scale), np.flatnonzero(lengths == d)
            asks = is_query[own]
            order = np.argsort(ids[own][~asks], kind="stable")
            x, xi, xk = some[~asks][order], ids[own][~asks][order], keys[own][~asks][order]
            q, qi, qk = some[asks], ids[own][asks], keys[own][asks]
            if not len(q) or not len(x):
                continue
            if np.abs(x).max() * np.abs(q).max() * d * len(x) >= 1 << 62 or np.abs(x).max() * np.abs(q).max() * d >= MOST:
                raise OverflowError("inner products are too large to be exact")
            by_key = np.argsort(xk)
            at = by_key[np.minimum(np.searchsorted(xk[by_key], qk), len(xk) - 1)]
            scores, where, _ = threshold_topk(q, np.where(xk[at] == qk, at, -1), x, k)
            have = where >= 0
            rows_of = np.repeat(np.arange(len(q)), have.sum(axis=1))
            out.append(pa.table({"query_row": qk[rows_of], "query_id": qi[rows_of], "score": scores[have], "vec_id": xi[where[have]]}))
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "score", "vec_id")})
        return pa.concat_tables(out).combine_chunks() if out else empty

    best = items.unionByName(asked).groupBy("a", "b").applyInArrow(pair, "query_row long, query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's twenty best rows."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
