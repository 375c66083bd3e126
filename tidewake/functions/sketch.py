"""Mergeable quantile sketch with relative error, as native expressions.

A positive value v falls in bucket ceil(ln v / ln g) with g = (1 + a) / (1 - a); a quantile is read
at zero-based rank floor(q * (n - 1)) and answered with the middle of its bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.01
MOST = (1 << 63) - 1
SKETCH = "struct<alpha: double, zero_count: bigint, count: bigint, min: bigint, max: bigint, buckets: map<int, bigint>>"


def gamma(alpha: float = ALPHA) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """Bucket of a positive value; null for zero and below."""
    return F.when(value > 0, F.ceil(F.ln(value.cast("double")) / F.lit(math.log(gamma(alpha)))).cast("int"))


def value_of(bucket: Column, alpha: float = ALPHA) -> Column:
    """Middle of a bucket, rounded and kept within 64 bits."""
    g = gamma(alpha)
    middle = F.round(2 * F.pow(F.lit(g), bucket) / (1 + g))
    return F.when(middle >= float(MOST), F.lit(MOST)).otherwise(F.least(middle, F.lit(9.2233720368547e18)).cast("long"))


def _check(q: float) -> float:
    if math.isnan(q) or not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    return q


def sketch_build(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """(by, sketch): counts by bucket first, which Spark combines before the shuffle, then the sketch."""
    v = F.col(value)
    counted = df.groupBy(*by, bucket_of(v, alpha).alias("__bucket")).agg(F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"))
    return counted.groupBy(*by).agg(collect_sketch(alpha).alias("sketch"))


def collect_sketch(alpha: float = ALPHA) -> Column:
    """Aggregate rows (__bucket, __n, __min, __max) of distinct buckets into a sketch."""
    entries = F.collect_list(F.when(F.col("__bucket").isNotNull(), F.struct("__bucket", "__n")))
    zero = F.coalesce(F.sum(F.when(F.col("__bucket").isNull(), F.col("__n"))), F.lit(0))
    return F.struct(F.lit(float(alpha)).alias("alpha"), zero.cast("long").alias("zero_count"), F.sum("__n").alias("count"), F.min("__min").cast("long").alias("min"), F.max("__max").cast("long").alias("max"), F.map_from_entries(entries).alias("buckets"))


def entries_quantile(entries: Column, zero_count: Column, count: Column, most: Column, q: float, alpha: float = ALPHA) -> Column:
    """The quantile of sorted (key, value) entries, bucket and count, beside ``zero_count`` values of zero or below."""
    rank = F.floor(F.lit(_check(q)) * (count - 1)).cast("long")
    start = F.struct(zero_count.cast("long").alias("upto"), F.lit(None).cast("int").alias("at"))
    step = lambda a, e: F.struct((a["upto"] + e["value"]).alias("upto"), F.when(a["at"].isNull() & (a["upto"] + e["value"] > rank), e["key"]).otherwise(a["at"]).alias("at"))
    at = F.aggregate(entries, start, step)["at"]
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(0)).when(rank < zero_count, F.lit(0)).when(at.isNull(), most).otherwise(value_of(at, alpha)).cast("long")


def sketch_quantile(sketch: Column, q: float, alpha: float = ALPHA) -> Column:
    """The quantile's value; 0 for an empty sketch or where zeros reach the rank."""
    return entries_quantile(F.array_sort(F.map_entries(sketch["buckets"])), sketch["zero_count"], sketch["count"], sketch["max"], q, alpha)


def sketch_merge(df: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """Add up the sketches of each group; sketches of different alpha are an error."""
    s = F.col(column)
    heads = df.groupBy(*by).agg(F.min(s["alpha"]).alias("lo"), F.max(s["alpha"]).alias("hi"), F.sum(s["zero_count"]).alias("zero_count"), F.sum(s["count"]).alias("count"), F.min(s["min"]).alias("min"), F.max(s["max"]).alias("max"))
    cells = df.select(*by, F.explode(s["buckets"]).alias("k", "n")).groupBy(*by, "k").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("buckets"))
    alpha = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("sketches of different alpha cannot be merged")).cast("double"))
    same = [heads[c].eqNullSafe(cells[c]) for c in by]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = heads.join(cells, on, "left")
    buckets = F.coalesce(cells["buckets"], F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>")))
    return joined.select(*(heads[c] for c in by), F.struct(alpha.alias("alpha"), "zero_count", "count", "min", "max", buckets.alias("buckets")).alias(column))


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact values at zero-based rank floor(q * (n - 1)) of each group, one column for each name.

    Values are counted before they are ranked, so a group's repeated values cost one row.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    ranked = counted.withColumns({"__upto": F.sum("__n").over(running), "__all": F.sum("__n").over(whole)})
    pick = lambda q: F.min(F.when(F.col("__upto") > F.floor(F.lit(_check(q)) * (F.col("__all") - 1)), F.col(value)))
    return ranked.groupBy(*by).agg(*(pick(q).alias(name) for name, q in quantiles.items()))


QUANTILE_METHODS = ("ddsketch", "exact", "kll", "approx")


def quantiles(df: DataFrame, by: list[str], value: str, q: dict[str, float], method: str = "ddsketch", alpha: float = ALPHA) -> DataFrame:
    """Quantiles of each group by the named summary."""
    if method == "ddsketch":
        return sketch_build(df, by, value, alpha).select(*by, *(sketch_quantile(F.col("sketch"), x, alpha).alias(n) for n, x in q.items()))
    if method == "exact":
        return exact_quantiles(df, by, value, q)
    if method == "kll":
        sk = df.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value)).alias("__s"))
        return sk.select(*by, *(F.kll_sketch_get_quantile_bigint("__s", F.lit(_check(x))).alias(n) for n, x in q.items()))
    if method == "approx":
        return df.groupBy(*by).agg(*(F.percentile_approx(value, _check(x), int(1 / alpha) * 100).alias(n) for n, x in q.items()))
    raise ValueError(f"method must be one of {QUANTILE_METHODS}")


def sketch_error(df: DataFrame, by: list[str], value: str, q: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """Each quantile's sketched and exact value and whether they differ by at most alpha of the exact one."""
    near, exact = quantiles(df, by, value, q, "ddsketch", alpha), exact_quantiles(df, by, value, {f"exact_{n}": x for n, x in q.items()})
    joined = near.join(exact, by)
    # a bucket's middle is rounded to a whole number
    ok = [(F.abs(F.col(n) - F.col(f"exact_{n}")) <= alpha * F.col(f"exact_{n}") + 0.5).alias(f"{n}_ok") for n in q]
    return joined.select(*by, *q, *(f"exact_{n}" for n in q), *ok)


def rank_error(df: DataFrame, by: list[str], value: str, q: dict[str, float], method: str) -> DataFrame:
    """How far, as a share of its group's rows, the rank of each quantile by ``method`` is from the wanted one.

    A value that repeats has all the ranks that it covers. Values are counted before they meet the
    quantiles, so a group's repeated values cost one row. Nulls count neither as rows nor as values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    found = quantiles(df, by, value, {f"__{n}": x for n, x in q.items()}, method)
    same = [counted[c].eqNullSafe(found[c]) for c in by]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = counted.join(found, on).select(*(counted[c] for c in by), value, "__n", *(f"__{n}" for n in q))
    upto = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0)) / F.sum("__n")
    off = lambda n, x: F.greatest(upto(F.col(value) < F.col(f"__{n}")) - x, x - upto(F.col(value) <= F.col(f"__{n}")), F.lit(0.0))
    return joined.groupBy(*by).agg(*(off(n, _check(x)).alias(n) for n, x in q.items()))
