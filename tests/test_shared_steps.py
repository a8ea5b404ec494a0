"""Steps that many queries share: read once, joined by value, spread over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabvet.operators import dependency as dep
from tabvet.operators import generate as gen
from tabvet.operators import models as mdl
from tabvet.operators.pairs import exact_quantiles, rank_within, spread
from tabvet.operators.splits import two_way_split


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_is_drawn_once(spark):
    df = spark.range(200).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    drawn = gen.bootstrap_sample(df, 100, seed=3)
    assert drawn.count() == 100
    assert "Join" not in _plan(drawn) and "md5" not in _plan(drawn)  # later reads draw nothing again


def test_split_rows_are_hashed_once(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("y"), (F.col("id") * 2.0).alias("x"))
    parts = two_way_split(df, "y", test=0.25)
    assert "md5" not in _plan(parts)
    assert {(r["y"], r["split"]): r["n"] for r in parts.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        (0, "test"): 13, (1, "test"): 12, (0, "train"): 37, (1, "train"): 38}


@pytest.mark.parametrize("limit", [None, 0])
def test_quantiles_count_values_once(spark, limit):
    df = spark.range(101).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    q = exact_quantiles(df, ["k"], "v", [0.0, 0.25, 1.0], single_task_rows=limit)
    assert "Range (" not in _plan(q)
    assert {r["p"]: r["q"] for r in q.collect()} == {0.0: 0.0, 0.25: 25.0, 1.0: 100.0}


def test_average_ranks_keep_rows_whole(spark):
    v = [(3.0, 1.0), (1.0, None), (3.0, float("nan")), (-0.0, 5.0), (0.0, 1.0), (None, 2.0)]
    df = spark.createDataFrame(v, "a double, b double")
    ranks = dep.average_ranks(df, ["a", "b"])
    assert "pivot" not in _plan(ranks).lower()
    want = pd.DataFrame(v, columns=["a", "b"]).astype(float).rank()
    got = ranks.select("a", "b").toPandas().astype(float)
    key = lambda t: sorted(map(str, t.fillna(-1.0).to_numpy().tolist()))
    assert key(got) == key(want)


def test_copula_scores_by_value(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    rows = [(float(a), float(a + b), "hi" if a > 0 else "lo") for a, b in zip(x, rng.normal(size=400), strict=True)]
    rows += [(None, 0.5, None), (0.25, None, "hi"), (float("nan"), 1.0, "lo")]
    model = gen.copula_fit(spark.createDataFrame(rows, "a double, b double, c string"))
    corr = np.array(model.corr)
    assert model.latent == ["a", "b", "c"] and np.allclose(corr, corr.T)
    assert 0.6 < corr[0, 1] < 0.8 and abs(corr[0, 2]) > 0.6
    assert gen.copula_sample(spark, model, 50).count() == 50


def test_known_group_size_is_not_measured(spark):
    ranked = rank_within(spark.range(5).withColumn("g", F.lit(0)), ["g"], ["id"], largest=5)
    assert sorted((r["id"], r["rank"]) for r in ranked.collect()) == [(i, i) for i in range(5)]


def test_spread_uses_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(spark.range(1000).coalesce(1)).rdd.getNumPartitions() >= n


def test_regression_split_is_read_from_one_copy(spark):
    df = spark.range(120).select((F.col("id") % 40).cast("double").alias("x"), ((F.col("id") % 40) * 3.0 + F.col("id") % 7).alias("y"))
    s = two_way_split(df, "y", test=0.25)
    got = mdl.evaluate_split(s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split"), "y", "regression", model="ridge").first()
    assert got["n"] == 30 and got["r2"] > 0.9
