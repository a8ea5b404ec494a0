"""The copula generator: levels in a table, conditions on levels, values and intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.operators import generate as gen


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(4)
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0.5], [0.8, 1, 0.3], [0.5, 0.3, 1]], 4000)
    rows = [(float(a), float(10 + 2 * b), int(round(50 + 10 * c)), f"level{int(40 * a) % 900:03d}", bool(c > 0.5), None if i % 10 == 0 else float(b))
            for i, (a, b, c) in enumerate(z)]
    df = spark.createDataFrame(rows, "x double, y double, n int, g string, f boolean, holes double")
    return gen.copula_fit(df), df


def test_levels_stay_in_a_table(spark, model):
    fitted, df = model
    levels = {(r.v): (r.lo, r.hi) for r in fitted.levels.where("col = 'g'").collect()}
    counts = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert set(levels) == set(counts) and all(hi - lo == pytest.approx(counts[v] / 4000) for v, (lo, hi) in levels.items())
    out = gen.copula_sample(spark, fitted, 8000, seed=1)
    assert out.count() == 8000 and out.where("g IS NULL OR f IS NULL OR x IS NULL").count() == 0
    got = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    most = max(counts, key=counts.get)
    assert set(got) <= set(counts) and got[most] == pytest.approx(2 * counts[most], rel=0.5)
    assert 0.05 < out.select(F.avg(F.col("holes").isNull().cast("int"))).first()[0] < 0.15
    assert out.stat.corr("x", "y") == pytest.approx(0.8, abs=0.05)


@pytest.mark.parametrize(("where", "test"), [
    ({"x": (0.5, 1.0)}, "x BETWEEN 0.5 AND 1.0"), ({"x": (None, -1.0), "n": (55, None)}, "x <= -1.0 AND n >= 55"), ({"n": 47}, "n = 47"),
    ({"n": (46.5, 48.2), "f": False, "x": (-0.2, 0.3)}, "n BETWEEN 47 AND 48 AND NOT f AND x BETWEEN -0.2 AND 0.3"),
    ({"y": 11.25}, "y = 11.25"), ({"holes": (0.0, 0.1)}, "holes BETWEEN 0.0 AND 0.1")])
def test_every_row_meets_the_conditions(spark, model, where, test):
    out = gen.copula_sample(spark, model[0], 500, seed=2, where=where)
    assert out.where(test).count() == out.count() == 500
    checked = gen.align_output(out, model[1], 500, {k: v for k, v in where.items() if isinstance(v, tuple)})
    assert checked.columns == model[1].columns


def test_the_others_follow_their_conditional_normal(spark, model):
    out = gen.copula_sample(spark, model[0], 6000, seed=3, where={"x": (0.9, 1.1)})
    mean, std = out.agg(F.avg("y"), F.stddev_pop("y")).first()
    assert mean == pytest.approx(10 + 2 * 0.8, abs=0.15) and std == pytest.approx(2 * (1 - 0.64) ** 0.5, abs=0.15)


def test_impossible_conditions(spark, model):
    for where in ({"x": (99.0, None)}, {"n": (46.2, 46.8)}, {"g": "nowhere"}, {"g": (1, 2)}, {"missing": 1}, {"x": (1.0, 0.5)}):
        with pytest.raises(gen.GeneratorError):
            gen.copula_sample(spark, model[0], 10, where=where)
