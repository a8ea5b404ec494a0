"""Rows of fits lie evenly over the cores; steps of fits and reports that read each table as seldom as they can."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabvet.functions.exprs import stable_value
from tabvet.operators import fidelity as fid
from tabvet.operators import models as mdl
from tabvet.operators.pairs import deal
from tabvet.session import cut_lineage, written


def _sizes(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_rows_of_a_fit_are_dealt_evenly(spark):
    lopsided = spark.range(3990).coalesce(1).unionByName(spark.range(3990, 4000).coalesce(1))
    sizes = _sizes(deal(lopsided, 1000))
    assert sum(sizes) == 4000 and len(sizes) == min(4, spark.sparkContext.defaultParallelism) and max(sizes) <= 1100
    assert _sizes(deal(lopsided, 4000)) == _sizes(cut_lineage(lopsided))  # a small table stays as it lies


def test_forests_keep_the_node_of_each_row():
    for task in ("classification", "regression"):
        assert mdl._estimator(task, "random_forest", 1, 2, 10).getCacheNodeIds()


def test_known_baseline_is_not_fitted_again(spark, monkeypatch):
    calls = []

    def scored(train, *a, **kw):
        calls.append(train.count())
        return spark.createDataFrame([(0.5, 1.0, 2.0)], "r2 double, mae double, rmse double")

    monkeypatch.setattr(mdl, "evaluate_split", scored)
    train, syn = spark.range(30).withColumn("y", F.lit(1.0)), spark.range(20).withColumn("y", F.lit(1.0))
    out = mdl.compare_augmentation(train, train, syn, "y", "regression", base={"r2": 0.25, "mae": 1.0, "rmse": 2.0})
    assert calls == [50] and {r["metric"]: r["baseline"] for r in out.collect()}["r2"] == 0.25


def test_fourier_sums_equal_those_of_the_vectors(spark):
    rows = [(float(i % 17), None if i % 7 == 0 else "ab"[i % 2], "x" if i % 5 else "z") for i in range(300)] + [(None, "a", "x"), (float("nan"), "b", "z")]
    df = spark.createDataFrame(rows, "n double, c string, d string")
    feats = mdl.fit_features(df, ["n"], ["c", "d"])
    unseen = df.unionByName(spark.createDataFrame([(1.0, "new", "x")], df.schema))
    x = np.array([r["x"] for r in feats.transform(unseen).select(vector_to_array("features").alias("x")).collect()])
    rng = np.random.default_rng(1)
    w, b = rng.normal(0, 3, (16, x.shape[1])), rng.uniform(0, 2 * np.pi, 16)
    prepped, _ = mdl.prepare_categoricals(unseen, ["c", "d"], feats.modes)
    parts = prepped.select("n", "_cat_c", "_cat_d").mapInArrow(mdl._feature_sums(feats, w, b), "n long, s array<double>").collect()
    assert sum(r["n"] for r in parts) == 303
    assert np.allclose(np.sum([r["s"] for r in parts], axis=0), (np.cos(x @ w.T + b) * np.sqrt(2 / 16)).sum(axis=0), atol=1e-4)


def test_modes_of_all_columns_come_from_one_job(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "c string, d string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out, modes = mdl.prepare_categoricals(df, ["c", "d"])
    assert modes == {"c": "a", "d": ""} and len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 4
    assert sorted(r["_cat_c"] for r in out.collect()) == ["a", "a", "a", "b", "b"]


def test_structure_of_both_tables_in_one_pass_each(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(150, 4)) * [1.0, 5.0, 1.0, 0.2]
    real, syn = (spark.createDataFrame([tuple(map(float, r)) for r in t] + [(None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double") for t in (a, b))
    got = mdl.pca_structure_score(real, syn, kinds=(["a", "b", "c", "d"], [])).first()
    ratios = [np.sort(np.linalg.eigvalsh(np.cov((t - a.mean(0)) / a.std(0), rowvar=False)))[::-1] for t in (a, b)]
    want = 1 - np.mean(np.abs(ratios[0] / ratios[0].sum() - ratios[1] / ratios[1].sum())[:3])
    assert got["status"] == "computed" and abs(got["structural_score"] - want) < 1e-6
    assert mdl.pca_structure_score(real.limit(4), syn, kinds=(["a", "b"], [])).first()["status"] == "not_applicable"


def test_row_keys_round_as_decimals_do(spark):
    rng = np.random.default_rng(4)
    v = [*rng.normal(0, 1e3, 500), *(rng.integers(-9999, 9999, 300) / 2e6), *rng.normal(0, 1e12, 300), 0.0, -0.0, 4.99999999999999e-7, 5e-7, -5e-7, 8.99e12, -9.1e12, float("inf"), float("nan")]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    old = F.when(F.abs("v") < 9e12, F.round(F.col("v") * 1_000_000.0).cast("bigint").cast("string")).otherwise(F.col("v").cast("string"))
    assert df.where(~stable_value(F.col("v"), df.schema["v"].dataType).eqNullSafe(old)).count() == 0


def test_written_keeps_columns_that_files_cannot_hold(spark):
    df = spark.range(3).select("id", F.lit(None).alias("nothing"), F.lit(1).alias("odd name,(x)"))
    assert sorted(map(tuple, written(df).collect())) == [(i, None, 1) for i in range(3)]
    assert sorted(map(tuple, written(df.drop("nothing")).collect())) == [(i, 1) for i in range(3)]


def test_counts_and_halves_are_made_once(spark):
    real = spark.range(60).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan(fid.numeric_cdfs(real, real, ["x"])) and "Range (" not in plan(fid.category_shares(real, real, ["c"]))
    assert {r["column_name"]: r["status"] for r in fid.distribution_report(real, real.drop("c")).collect()} == {"x": "computed", "c": "missing_in_synthetic"}
