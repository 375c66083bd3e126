"""Ranks of quantile summaries and the dealing of keys, against plain Python."""

import math

from pyspark.sql import functions as F

from tidewake.functions import keys, sketch


def test_rank_error_with_ties_nulls_and_a_null_group(spark):
    rows = [("a", v) for v in [1, 1, 1, 2, 5, 9, 9, 9, 9, 40]] + [("a", None), (None, 7), (None, 8), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    for method in ("exact", "approx", "ddsketch"):
        q = {"p50": 0.5, "p95": 0.95}
        found = {r["g"]: r for r in sketch.quantiles(df, ["g"], "v", q, method).collect()}
        got = {r["g"]: r for r in sketch.rank_error(df, ["g"], "v", q, method).collect()}
        assert set(got) == {"a", None}
        for g, r in got.items():
            values = [v for k, v in rows if k == g and v is not None]
            for name, x in q.items():
                below, upto = (sum(1 for v in values if test(v, found[g][name])) / len(values) for test in (int.__lt__, int.__le__))
                assert math.isclose(r[name], max(below - x, x - upto, 0.0), abs_tol=1e-12)


def test_a_key_has_one_partition_and_keeps_its_order(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (1000 - F.col("id")).alias("t"))
    parts = [[(r["k"], r["t"]) for r in part] for part in keys.shard(df, 3, ["k"], ["t"]).rdd.glom().collect()]
    assert len(parts) == 3 and sum(map(len, parts)) == 1000
    assert all(p == sorted(p, key=lambda r: r[1]) for p in parts)
    assert sum(len({k for k, _ in p}) for p in parts) == 7
