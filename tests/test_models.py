"""Model fits against closed forms; row keys and text rules on awkward values."""

import numpy as np
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from tabvet.functions.exprs import row_key
from tabvet.operators import models, text
from tabvet.plans.queries import QUERIES
from tests.conftest import SF


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=40)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, _y double")
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    fit = models._estimator("regression", "ridge", 1, 0, 40, float(np.std(y))).fit(data)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    np.testing.assert_allclose(fit.coefficients.toArray(), want, rtol=1e-6)


def test_two_classes_stay_two(spark):
    rows = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "n").otherwise("y").alias("target"))
    out = models.evaluate_split(rows, rows.unionByName(spark.createDataFrame([(1.0, "unseen")], "x double, target string")), "target",
                                "classification", model="logistic_regression")
    assert out.count() >= 1
    assert len(StringIndexer(inputCol="target", outputCol="i", handleInvalid="error").fit(rows).labels) == 2


def test_unseen_level_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "_cat_k string")
    fit = models.mixed_features(train, [], ["k"]).fit(train)
    got = {r._cat_k: r.features.toArray().tolist() for r in fit.transform(spark.createDataFrame([("a",), ("b",), ("zz",)], "_cat_k string")).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "zz": [0.0, 0.0]}


def test_row_key_of_large_values(spark):
    df = spark.createDataFrame([(1e13,), (float("nan"),), (float("inf"),), (1.5,), (None,)], "x double")
    assert df.select(row_key(df).alias("k")).distinct().count() == 5


def test_repeated_ids_keep_their_own_rules(spark):
    rules = text.rules_frame(spark, {"kind": {"p": "apple", "q": "pear"}})
    df = spark.createDataFrame([(1, "an Apple", "p"), (1, "nothing", "q")], "id int, t string, kind string")
    got = sorted((r.matched_fields, r.consistent) for r in text.text_consistency(df, "t", rules, "id").collect())
    assert got == [([], False), (["kind"], True)]


def test_mixed_features_of_the_whole_table(spark):
    got = QUERIES["d9_mixed_features_lineitem"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_knn_votes_equal_a_stable_sort():
    rng = np.random.default_rng(1)
    x, ref = (np.hstack([rng.integers(0, 3, (n, 2)) / 2.0, rng.integers(0, 2, (n, 3))]) for n in (300, 60))
    y = rng.integers(0, 2, 60).astype(float)
    d = ((x[:, None, :] - ref[None, :, :]) ** 2).sum(-1)
    want = y[np.argsort(d, axis=1, kind="stable")[:, :5]].mean(axis=1)
    np.testing.assert_allclose(models.knn_votes(x, ref, y, 5, 2, chunk=64), want)


def test_knn_scores_every_held_out_row(spark, monkeypatch):
    scored = []
    real_auc = models.roc_auc
    monkeypatch.setattr(models, "roc_auc", lambda df, *a: (scored.append(df.groupBy("_label").count().collect()), real_auc(df, *a))[1])
    real = spark.range(400).select((F.col("id") * 37 % 401).cast("double").alias("x"))
    syn = spark.range(300).select((F.col("id") * 37 % 401 + 0.5).cast("double").alias("x"))
    out = models.knn_discriminator(real, syn, cap=20, kinds=(["x"], [])).first()
    assert {r["_label"]: r["count"] for r in scored[0]} == {0.0: 200, 1.0: 150}
    assert out["status"] == "computed" and 0.0 <= out["auc"] <= 1.0


def test_discriminators_score_every_held_out_row(spark, monkeypatch):
    scored = []
    real_auc = models.roc_auc
    monkeypatch.setattr(models, "roc_auc", lambda df, *a: (scored.append(df.groupBy("_label").count().collect()), real_auc(df, *a))[1])
    monkeypatch.setattr(models, "DISCRIMINATOR_TREES", 2)
    boosting = models.GBTClassifier
    monkeypatch.setattr(models, "GBTClassifier", lambda **kw: boosting(**(kw | {"maxIter": 2})))
    real = spark.range(400).select((F.col("id") * 37 % 401).cast("double").alias("x"))
    syn = spark.range(300).select((F.col("id") * 37 % 401 + 0.5).cast("double").alias("x"))
    out = models.discriminator_ensemble(real, syn, cap=20, kinds=(["x"], [])).collect()
    assert [r["status"] for r in out] == ["computed"] * 3
    assert [{r["_label"]: r["count"] for r in s} for s in scored] == [{0.0: 200, 1.0: 150}] * 3


def test_mmd_over_all_rows_knows_rare_levels(spark, monkeypatch):
    fitted = []
    fit = models.fit_features
    monkeypatch.setattr(models, "fit_features", lambda *a, **kw: (fitted.append(fit(*a, **kw)), fitted[-1])[1])
    real = spark.range(4000).select(F.when(F.col("id") < 12, F.concat(F.lit("rare"), F.col("id"))).otherwise("a").alias("k"))
    syn = spark.range(4000).select(F.lit("a").alias("k"))
    assert models.mmd(real, syn, cap=None, n_features=16, kinds=([], ["k"])).first()["status"] == "computed"
    labels = [s for s in fitted[0].model.stages if hasattr(s, "labels")][0].labels
    assert sorted(labels) == sorted(["a", *(f"rare{i}" for i in range(12))])


def test_discriminators_are_fitted_on_every_row(spark, monkeypatch):
    """A level of few rows that a sample of 500 rows a table would hardly hold is told apart, and every training row counts."""
    fitted = {}

    def noted(kind):
        est = getattr(models, kind)
        fit = est.fit

        def run(self, df, *a):
            fitted[kind] = df.agg(F.sum("w") if "w" in df.columns else F.count(F.lit(1))).first()[0]
            return fit(self, df, *a)

        monkeypatch.setattr(est, "fit", run)

    for kind in ("LogisticRegression", "RandomForestClassifier", "GBTClassifier"):
        noted(kind)
    boosting = models.GBTClassifier
    monkeypatch.setattr(models, "GBTClassifier", lambda **kw: boosting(**(kw | {"maxIter": 2})))
    monkeypatch.setattr(models, "DISCRIMINATOR_TREES", 3)
    rows = spark.range(3000)
    x = (F.col("id") * 37 % 1009).cast("double").alias("x")
    real = rows.select(x, F.when(F.col("id") % 50 < 49, "a").otherwise(F.concat(F.lit("r"), (F.col("id") % 7).cast("string"))).alias("k"))
    syn = rows.select(x, F.lit("a").alias("k"))
    out = {r.model: r for r in models.discriminator_ensemble(real, syn, kinds=(["x"], ["k"])).collect()}
    assert fitted == dict.fromkeys(fitted, 3000) and len(fitted) == 3
    assert {r.status for r in out.values()} == {"computed"}


def test_tree_bins_come_from_all_rows(spark):
    """Each value of few is a bin; of many, the bins hold about equally many rows."""
    df = spark.range(6400).select((F.col("id") % 20).cast("double").alias("x0"), F.col("id").cast("double").alias("x1"), F.lit(1.0).alias("x2"))
    few, many, one = models._tree_edges(df)
    assert few == [float(i) for i in range(1, 20)] and one == []
    assert len(many) == 31 and np.allclose(many, np.arange(200, 6400, 200), atol=15)


def test_forests_draw_single_rows_or_small_portions(spark, monkeypatch):
    cells = spark.createDataFrame([(0.0, [1.0], 5.0), (1.0, [0.0], 300.0)], "_label double, features array<double>, w double")
    assert sorted((r._label, r.w) for r in models._portions(cells).collect()) == [(0.0, 1.0)] * 5 + [(1.0, 1.0)] * 300
    monkeypatch.setattr(models, "FOREST_DRAWS", 61)
    assert sorted((r._label, r.w) for r in models._portions(cells).collect()) == [(0.0, 5.0)] + [(1.0, 5.0)] * 60
