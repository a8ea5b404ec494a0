"""Metric identities (re-created from the reference's evaluation tests)."""

from tabvet.operators import dependency as dep
from tabvet.operators import fidelity as fid


def _pair(spark, shift=0, seg_b="B"):
    real = spark.createDataFrame([(i, "A" if i % 2 else "B") for i in range(20)], "amount int, segment string")
    syn = spark.createDataFrame([(i + shift, "A" if i % 2 else seg_b) for i in range(20)], "amount int, segment string")
    return real, syn


def test_identical_tables_score_perfectly(spark):
    real, syn = _pair(spark)
    assert fid.fidelity_score(real, syn).first().fidelity_score == 1.0
    assert fid.ks_statistic(real, syn).first().ks_statistic == 0.0
    js = fid.js_divergence(real, syn).first()
    assert js.jensen_shannon_divergence == 0.0 and js.category_coverage == 1.0


def test_shifted_tables_score_badly(spark):
    real, syn = _pair(spark, shift=100, seg_b="C")
    w = fid.wasserstein(real, syn).first()
    assert w.normalized_wasserstein > 1
    tv = {r.column_name: r.total_variation for r in fid.total_variation(real, syn).collect()}
    assert tv["segment"] == 0.5
    assert fid.ks_statistic(real, syn).first().ks_statistic == 1.0


def test_histogram_overlap_closed_last_bin(spark):
    real, syn = _pair(spark)
    assert fid.histogram_overlap(real, syn).first().histogram_overlap == 1.0


def test_correlation_score_constant_column_is_zero_not_error(spark):
    rows = [(i, 5, float(i) * 2) for i in range(30)]
    df = spark.createDataFrame(rows, "a int, c int, b double")
    pairs = {(r.a, r.b): r.rho for r in fid.pearson_pairs(df, ["a", "c", "b"]).collect()}
    assert pairs[("a", "c")] == 0.0 and abs(pairs[("a", "b")] - 1.0) < 1e-12


def test_dependency_on_dependent_pair(spark):
    rows = [(i, 2 * i, "A" if i < 10 else "B") for i in range(20)]
    real = spark.createDataFrame(rows, "x int, y int, g string")
    out = {r.part: r.value for r in dep.dependency_similarity(real, real).collect()}
    assert out["pearson_similarity"] == 1.0 and out["spearman_similarity"] == 1.0
    eta = dep.correlation_ratio(real, ["x"], ["g"]).first().eta
    assert 0.8 < eta <= 1.0


def test_cramers_v_perfect_association(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")] * 10, "p string, q string")
    assert dep.cramers_v(df, ["p", "q"]).first().cramers_v == 1.0
