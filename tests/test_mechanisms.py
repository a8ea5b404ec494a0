"""Shared mechanisms: prefix sums, ranks, lag/ffill, quantiles, seeded uniforms."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabvet.functions.exprs import seeded_uniform
from tabvet.operators.pairs import (dense_index, exact_quantiles, expand_counts, ffill_over, lag_over, prefix_sum,
                                    rank_within)


def test_prefix_sum_matches_window_for_any_partitioning(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).cast("string").alias("k"),
                                     ((F.col("id") * 7919) % 1009).cast("double").alias("v"),
                                     F.lit(1).alias("w")).groupBy("k", "v").agg(F.sum("w").alias("w"))
    ref = {(r.k, r.v): r.c for r in df.withColumn("c", F.sum("w").over(Window.partitionBy("k").orderBy("v"))).collect()}
    for parts in (1, 7):
        got = {(r.k, r.v): r.cum_w for r in prefix_sum(df, ["k"], "v", ["w"], partitions=parts, single_task_rows=0).collect()}
        assert {(r.k, r.v): r.cum_w for r in prefix_sum(df, ["k"], "v", ["w"]).collect()} == ref
        assert got == ref


def test_prefix_sum_next_value(spark):
    df = spark.createDataFrame([("a", float(x), 1) for x in [5, 1, 3, 9]], "k string, v double, w int")
    rows = sorted(prefix_sum(df, ["k"], "v", ["w"], next_value=True, partitions=3, single_task_rows=0).collect(), key=lambda r: r.v)
    assert [r.next_v for r in rows] == [3.0, 5.0, 9.0, None]
    assert [r.cum_w for r in rows] == [1, 2, 3, 4]


def test_rank_within_is_dense_and_exact(spark):
    df = spark.range(0, 500).select((F.col("id") % 2).alias("g"), seeded_uniform(1, F.col("id")).alias("u"))
    ranked = rank_within(df, ["g"], ["u"], "r", partitions=5, single_task_rows=0).collect()
    for g in (0, 1):
        rs = sorted(r.r for r in ranked if r.g == g)
        assert rs == list(range(250))
        order = [r.r for r in sorted((r for r in ranked if r.g == g), key=lambda r: r.u)]
        assert order == list(range(250))


def test_dense_index_with_duplicate_rows(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3, "x int")
    idx = sorted(r._idx for r in dense_index(df, ["x"], single_task_rows=0).collect())
    assert sorted(r._idx for r in dense_index(df, ["x"]).collect()) == list(range(53))
    assert idx == list(range(53))


def test_expand_counts_splits_hot_rows(spark):
    df = spark.createDataFrame([("hot", 10000), ("cold", 3), ("none", 0)], "k string, n long")
    out = expand_counts(df, "n", chunk=1000)
    assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == {"hot": 10000, "cold": 3}


def test_lag_and_ffill_across_slices(spark):
    rows = [("a", t, None if t % 3 else float(t)) for t in range(40)] + [("b", t, float(t) if t == 0 else None) for t in range(10)]
    df = spark.createDataFrame(rows, "e string, t long, v double")
    lag = {(r.e, r.t): r.prev_t for r in lag_over(df, ["e"], "t", ["t"], partitions=6, single_task_rows=0).collect()}
    assert lag == {(r.e, r.t): r.prev_t for r in lag_over(df, ["e"], "t", ["t"]).collect()}
    assert lag[("a", 0)] is None and all(lag[("a", t)] == t - 1 for t in range(1, 40))
    ff = {(r.e, r.t): r.v for r in ffill_over(df, ["e"], "t", ["v"], partitions=6, single_task_rows=0).collect()}
    assert ff == {(r.e, r.t): r.v for r in ffill_over(df, ["e"], "t", ["v"]).collect()}
    assert ff[("a", 5)] == 3.0 and ff[("a", 39)] == 39.0 and ff[("b", 9)] == 0.0


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(3).integers(0, 50, 301)]
    df = spark.createDataFrame([("k", v) for v in vals], "g string, v double")
    got = {r.p: r.q for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], single_task_rows=0).collect()}
    assert got == {r.p: r.q for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    for p in (0.1, 0.5, 0.9):
        assert abs(got[p] - float(np.quantile(vals, p))) < 1e-9


def test_seeded_uniform_is_stable_and_uniform(spark):
    df = spark.range(0, 20000).select(seeded_uniform(42, F.col("id"), "t").alias("u"))
    stats = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0.0 <= stats[0] and stats[1] < 1.0 and abs(stats[2] - 0.5) < 0.02
    a = [r.u for r in df.repartition(7).orderBy("u").limit(5).collect()]
    b = [r.u for r in df.coalesce(1).orderBy("u").limit(5).collect()]
    assert a == b


def test_sketch_kinds_agree_with_exact_counts(spark):
    from tabvet.operators.pairs import distinct_counts, kind_counts, kinds_from

    df = spark.range(20000).select((F.col("id") % 12).alias("twelve"), (F.col("id") % 13).alias("thirteen"),
                                   (F.col("id") * 1.5).alias("wide"), (F.col("id") % 3).cast("string").alias("s"))
    approx = kind_counts(df)
    exact = distinct_counts(df)
    assert approx["twelve"] == 12 and approx["thirteen"] == 13 and approx["s"] == 3
    assert kinds_from(df, approx) == kinds_from(df, exact) == (["thirteen", "wide"], ["twelve", "s"])
