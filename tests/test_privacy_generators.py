"""Privacy checks against brute force, and generator contracts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.operators import generate as gen
from tabvet.operators import privacy as priv


def _tables(spark):
    rng = np.random.default_rng(0)
    real = [(int(a), float(b), str(c)) for a, b, c in zip(rng.integers(0, 100, 60), rng.normal(0, 1, 60), rng.choice(["x", "y"], 60))]
    syn = real[:10] + [(int(a), float(b), str(c)) for a, b, c in zip(rng.integers(0, 100, 30), rng.normal(0, 1, 30), rng.choice(["x", "y"], 30))]
    cols = "a int, b double, c string"
    return spark.createDataFrame(real, cols), spark.createDataFrame(syn, cols), real, syn


def test_exact_match_rate(spark):
    r, s, real, syn = _tables(spark)
    got = priv.exact_match_rate(r, s).first()
    expected = sum(1 for row in syn if row in set(real)) / len(syn)
    assert got.exact_duplicate_rate == round(expected, 6)


def test_near_match_rate_equals_brute_force(spark):
    r, s, real, syn = _tables(spark)
    kinds = (["a", "b"], ["c"])
    got = priv.near_match_rate(r, s, kinds, sample_syn=None, sample_real=1000).first()
    span_a = max(x[0] for x in real) - min(x[0] for x in real)
    span_b = max(x[1] for x in real) - min(x[1] for x in real)
    close = 0
    for sa, sb, sc in syn:
        best = min((abs(sa - ra) / span_a + abs(sb - rb) / span_b + (0 if sc == rc else 1)) / 3 for ra, rb, rc in real)
        close += best < 0.05
    assert got.close_rows == close and got.probed_rows == len(syn)


def _brute_close(real, syn, n_num):
    spans = []
    for i in range(n_num):
        vals = [r[i] for r in real if r[i] is not None]
        spans.append((max(vals) - min(vals) if vals else 1.0) or 1.0)

    def distance(s, r):
        gaps = [abs(s[i] - r[i]) / spans[i] for i in range(n_num) if s[i] is not None and r[i] is not None]
        gaps += [float(a != b) for a, b in zip(s[n_num:], r[n_num:], strict=True)]
        return sum(gaps) / len(gaps) if gaps else 1e9

    return sum(min(distance(s, r) for r in real) < 0.05 for s in syn)


@pytest.mark.parametrize("n_num,n_cat", [(2, 1), (1, 0), (0, 2), (3, 2), (2, 20)])
def test_near_match_over_all_rows_equals_brute_force(spark, n_num, n_cat):
    rng = np.random.default_rng(n_num * 31 + n_cat)

    def rows(n, wide):
        out = []
        for _ in range(n):
            num = [None if rng.random() < 0.1 else float(v) for v in rng.normal(0, wide, n_num)]
            out.append((*num, *(None if rng.random() < 0.1 else str(v) for v in rng.choice(["x", "y"], n_cat, p=[0.95, 0.05]))))
        return out

    real, syn = rows(70, 1.0), rows(60, 1.5)
    syn += real[:5] * 2
    cols = [f"c{i}" for i in range(n_num + n_cat)]
    schema = ", ".join(f"{c} {'double' if i < n_num else 'string'}" for i, c in enumerate(cols))
    r, s = spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema)
    got = priv.near_match_rate(r, s, (cols[:n_num], cols[n_num:]), sample_syn=None, sample_real=None).first()
    assert (got.close_rows, got.probed_rows) == (_brute_close(real, syn, n_num), len(syn))


def test_near_copies_outside_the_sample_are_found(spark):
    real = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 1.0).alias("x"))
    syn = spark.range(100).select((F.col("id") * 20).cast("string").alias("k"), (F.col("id") * 20 + 0.5).alias("x"))
    got = priv.near_match_rate(real, syn, (["x"], ["k"]), sample_syn=None, sample_real=None).first()
    assert (got.close_rows, got.probed_rows) == (100, 100)
    score = priv.privacy_score(real, syn, (["x"], ["k"]), sample_syn=None, sample_real=None).first()
    assert score.high_similarity_rate == 1.0 and score.privacy_score == 0.7


def test_bootstrap_contract(spark):
    rows = [(20 + i, 1000 * i, "A" if i % 10 else "B", int(i < 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "age int, income int, city string, target int")
    out = gen.bootstrap_sample(df, 25, seed=1).drop("_draw")
    assert out.count() == 25 and out.columns == df.columns and out.schema == df.schema
    cond = gen.bootstrap_sample(df, 15, seed=1, where={"target": 1}).drop("_draw")
    assert {r.target for r in cond.collect()} == {1}
    stats = cond.agg(F.min("income"), F.max("income")).first()
    assert stats[0] >= 0 and stats[1] <= 39000
    with pytest.raises(gen.GeneratorError):
        gen.bootstrap_sample(df, 5, where={"city": "Z"})


def test_bootstrap_deterministic_across_partitions(spark):
    df = spark.range(300).select("id", (F.col("id") * 0.5).alias("v"))
    a = sorted(tuple(r) for r in gen.bootstrap_sample(df.repartition(7), 100, seed=3).collect())
    b = sorted(tuple(r) for r in gen.bootstrap_sample(df.coalesce(1), 100, seed=3).collect())
    assert a == b


def test_copula_keeps_dependence_and_condition(spark):
    rows = [(float(i), float(2 * i + (i % 3)), "A" if i < 100 else "B") for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    model = gen.copula_fit(df)
    out = gen.copula_sample(spark, model, 400, seed=5)
    rho = out.stat.corr("x", "y")
    assert rho > 0.9
    cond = gen.copula_sample(spark, model, 100, seed=5, where={"g": "B"})
    assert {r.g for r in cond.collect()} == {"B"}
    assert cond.agg(F.avg("x")).first()[0] > 80


def test_codec_round_trip(spark):
    rows = [(float(i) if i != 3 else None, ["a", "b", None][i % 3], i % 2 == 0) for i in range(32)]
    df = spark.createDataFrame(rows, "amount double, kind string, flag boolean")
    enc, state = gen.mixed_encode(df)
    back = gen.mixed_decode(enc, state).collect()
    for orig, got in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)),
                         sorted(back, key=lambda r: (r.amount is None, r.amount or 0))):
        assert (orig[0] is None) == (got.amount is None)
        if orig[0] is not None:
            assert abs(orig[0] - got.amount) < 1e-5


def test_codec_is_lossless_beyond_its_grid(spark):
    """5,000 distinct values on a 1,000-point grid, a value holding many grid points, NaN, large and tiny numbers."""
    rows = [(i, 7.0 if i % 4 == 0 else (i * 977 % 5000) ** 2 * 0.37, float("nan") if i % 100 == 9 else -1e-3 * i, f"c{i}")
            for i in range(5000)]
    df = spark.createDataFrame(rows, "id bigint, amount double, small double, name string")
    enc, state = gen.mixed_encode(df)
    assert state.flagged == ["small"] and "amount__missing" not in enc.columns and state.sizes["name"] == 5000
    back = {r.id: r for r in gen.mixed_decode(enc, state).collect()}
    assert len(back) == 5000
    for i, amount, small, name in rows:
        assert abs(back[i].amount - amount) < 1e-5 and back[i].name == name
        assert back[i].small is None if small != small else abs(back[i].small - small) < 1e-9
    assert enc.agg(F.max(F.abs("amount"))).first()[0] > 2.5


def test_normal_distribution_functions(spark):
    from statistics import NormalDist
    from tabvet.functions.exprs import norm_cdf, probit, probit_step
    zs = spark.createDataFrame([(z / 7,) for z in range(-60, 61)], "z double")
    for r in zs.select("z", norm_cdf(F.col("z")).alias("p")).collect():
        assert abs(r.p - NormalDist().cdf(r.z)) < 1e-14
    ps = spark.createDataFrame([((k + 0.5) / 1000,) for k in range(1000)], "p double").withColumn("s", probit(F.col("p")))
    for r in ps.select("p", probit_step(F.col("s"), F.col("p")).alias("z")).collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-11


def test_registry_rules():
    with pytest.raises(gen.GeneratorError):
        gen.register_generator("Bad-Name", lambda d: d, lambda *a: None)
    with pytest.raises(gen.GeneratorError):
        gen.register_generator("bootstrap", lambda d: d, lambda *a: None)
    with pytest.raises(gen.GeneratorError):
        gen.get_generator("missing_one")
