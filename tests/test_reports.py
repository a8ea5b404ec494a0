"""Column reports, comparison tables, run records, generators of windows, experiments."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.operators import fidelity as fid
from tabvet.operators import generate as gen
from tabvet.operators import sequences as seq
from tabvet.plans import jobs
from tabvet.sources import io as sio


def _pair(spark):
    rng = np.random.default_rng(3)
    real = [(float(x), 5.0, None if i else 1.0, "ab"[i % 2], None, float(i)) for i, x in enumerate(rng.normal(size=60).round(1))]
    syn = [(float("nan") if i == 0 else None if i == 1 else float(x), 5.0, 2.0, "abc"[i % 3], "z") for i, x in enumerate(rng.normal(0.5, 2, 45).round(1))]
    return (spark.createDataFrame(real, "x double, flat double, rare double, k string, empty string, gone double").repartition(3),
            spark.createDataFrame(syn, "x double, flat double, rare double, k string, empty string").repartition(2))


KINDS = (["x", "flat", "rare", "gone"], ["k", "empty"])


def test_distribution_report(spark):
    real, syn = _pair(spark)
    got = {r.column_name: r for r in fid.distribution_report(real, syn, KINDS).collect()}
    assert {c: (r.kind, r.status) for c, r in got.items()} == {
        "x": ("numerical", "computed"), "flat": ("numerical", "computed"), "rare": ("numerical", "not_applicable"),
        "gone": ("numerical", "missing_in_synthetic"), "k": ("categorical", "computed"), "empty": ("categorical", "not_applicable")}
    a = np.array([r.x for r in real.collect()])
    b = np.array([r.x for r in syn.collect() if r.x is not None and not np.isnan(r.x)])
    support = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(v), support, side="right") / len(v) for v in (a, b))
    q = np.linspace(0.1, 0.9, 9)
    edges = np.linspace(support[0], support[-1], 11)
    place = [np.minimum(((v - support[0]) * (10.0 / (support[-1] - support[0]))).astype(int), 9) for v in (a, b)]
    shares = [np.bincount(p, minlength=10) / len(p) for p in place]
    want = {"ks_statistic": np.abs(fa - fb).max(), "normalized_wasserstein": (np.abs(fa - fb)[:-1] * np.diff(support)).sum() / a.std(),
            "quantile_error": np.abs(np.quantile(a, q) - np.quantile(b, q)).mean() / a.std(), "histogram_overlap": np.minimum(*shares).sum()}
    for name, value in want.items():
        assert got["x"][name] == pytest.approx(value, abs=2e-6)
    assert (got["flat"].ks_statistic, got["flat"].normalized_wasserstein, got["flat"].quantile_error, got["flat"].histogram_overlap) == (0, 0, 0, 1)
    assert got["k"].total_variation_distance == pytest.approx(1 / 3, abs=1e-6) and got["k"].category_coverage == 1.5
    assert got["gone"].ks_statistic is None and got["empty"].category_coverage is None and got["x"].category_coverage is None

    bins = {(r.column_name, r.bin): r for r in fid.histogram_comparison(real, syn, KINDS).collect()}
    assert {k for k in bins if k[0] == "flat"} == {("flat", 0)} and bins["flat", 0].original_rows == 60
    for i in range(10):
        r = bins["x", i]
        assert (r.original_rows, r.synthetic_rows) == tuple(int((p == i).sum()) for p in place)
        assert (r.lower, r.upper) == (pytest.approx(edges[i], abs=1e-6), pytest.approx(edges[i + 1], abs=1e-6))
    assert sum(r.synthetic_share for k, r in bins.items() if k[0] == "x") == pytest.approx(1, abs=1e-5)


def test_report_equals_the_single_metrics(spark):
    real, syn = _pair(spark)
    one = {r.column_name: r for r in fid.distribution_report(real, syn, KINDS).collect()}
    for metric in (fid.ks_statistic, fid.wasserstein, fid.quantile_error, fid.histogram_overlap):
        for r in metric(real, syn, (["x", "flat"], [])).collect():
            name = r.__fields__[-1] if metric is not fid.ks_statistic else "ks_statistic"
            assert r[name] == pytest.approx(one[r.column_name][name], abs=1e-6)


def test_class_shares_and_matrices(spark):
    real = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), (None, 3.0, 6.0), ("b", 4.0, 8.0)], "k string, x double, y double")
    syn = spark.createDataFrame([("b", 1.0, 3.0), ("c", 2.0, 3.0)], "k string, x double, y double")
    got = {r["class"]: (r.original_share, r.synthetic_share) for r in fid.class_share_comparison(real, syn, "k").collect()}
    assert got == {"a": (0.5, 0.0), "nan": (0.25, 0.0), "b": (0.25, 0.5), "c": (0.0, 0.5)}
    m = {(r.row_column, r.column_name): (r.original, r.synthetic, r.difference) for r in fid.correlation_comparison(real, syn, (["x", "y"], [])).collect()}
    assert m == {("x", "x"): (1, 1, 0), ("y", "y"): (1, 0, -1), ("x", "y"): (1, 0, -1), ("y", "x"): (1, 0, -1)}
    assert fid.correlation_comparison(real, syn, ([], [])).count() == 0


def test_records_and_split_ids(spark):
    path = tempfile.mkdtemp(prefix="tabvet-records-")
    sio.write_run_record(spark, f"{path}/runs", "r1", "running", {"b": 1, "a": None})
    sio.write_run_record(spark, f"{path}/runs", "r1", "failed", {}, "h", "ValueError", "no rows")
    got = {(r.run_id, r.status, r.config, r.dataset_hash, r.failure_type) for r in sio.read_run_records(spark, f"{path}/runs").collect()}
    assert got == {("r1", "running", '{"a": null, "b": 1}', None, None), ("r1", "failed", "{}", "h", "ValueError")}
    with pytest.raises(ValueError):
        sio.write_run_record(spark, f"{path}/runs", "r1", "lost", {})
    split = spark.createDataFrame([(1, "train", "x"), (2, "test", "y"), (3, "train", "z")], "id int, split string, text string")
    back = spark.read.parquet(sio.write_split_ids(split, f"{path}/split", ["id"]))
    assert {tuple(r) for r in back.select("id", "split").collect()} == {(1, "train"), (2, "test"), (3, "train")}


def test_latest_state_of_ties(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("r", "a", "running", "p", at), ("r", "b", "queued", "q", at), ("r", "c", "completed", "s", at - dt.timedelta(1)),
                                 ("t", "a", "failed", None, at)], sio.RUN_LOG_SCHEMA)
    got = {r.run_id: (r.event, r.status, r.payload, r.created_at, r.n_events) for r in sio.run_log_latest(log).collect()}
    assert got == {"r": ("b", "queued", "q", at - dt.timedelta(1), 3), "t": ("a", "failed", None, at, 1)}
    assert sio.run_log_latest(log.limit(0)).count() == 0


def _windows(spark, n=12):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(f"w{i}", rng.uniform(-1, 1, (6, 2)).tolist()) for i in range(n)], "window_id string, values array<array<double>>")


def test_jittered_windows(spark):
    w = _windows(spark)
    base = {r.window_id: np.array(r["values"]) for r in w.collect()}
    got = seq.jittered_bootstrap(w.repartition(3), 40, seed=7).collect()
    assert len(got) == 40 and {r.window_id for r in got} == {f"jittered_{i}" for i in range(40)}
    moves = []
    for r in got:
        v = np.array(r["values"])
        assert v.shape == (6, 2) and np.abs(v).max() <= 1
        inside = np.abs(v) < 1
        moves.append((v - base[r.source_window_id])[inside])
    moved = np.concatenate(moves)
    assert abs(moved.mean()) < 0.01 and 0.03 < moved.std() < 0.06 and len(np.unique(moved)) == len(moved)
    again = seq.jittered_bootstrap(w.repartition(1), 40, seed=7).collect()
    assert sorted(map(tuple, ((r.window_id, str(r["values"])) for r in again))) == sorted(map(tuple, ((r.window_id, str(r["values"])) for r in got)))


def test_score_from_forecasting(spark):
    per = spark.createDataFrame([(0.1, 0.2), (0.3, None)], "ks_statistic double, acf_error double")
    privacy = spark.createDataFrame([(0.0, 0.5)], "exact_training_match_rate double, near_training_match_rate double")
    forecast = spark.createDataFrame([("real_only", 9.0), ("synthetic_only", 3.0)], "training string, mae double")
    plain, scored, none = (seq.temporal_gates(per, privacy, f).first() for f in (None, forecast, forecast.limit(0)))
    assert plain.validation_score == pytest.approx(1 / 1.2, abs=1e-6) and scored.validation_score == 0.25 and none.validation_score is None
    assert plain.failed_gates == scored.failed_gates == ["near_match"]


def test_failed_candidate_is_kept_and_other_errors_raise(spark, monkeypatch):
    def broken(df):
        raise RuntimeError("no fit")

    if "broken_fit" not in gen._REGISTRY:
        gen.register_generator("broken_fit", broken, lambda *a: None)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), "ab"[i % 2], i) for i, x in enumerate(rng.normal(size=120))], "x double, k string, n int")
    out = jobs.run_experiment_tables(df, candidates=("broken_fit", "bootstrap", "bootstrap"))
    trials = {r.generator: r for r in out["trials"].collect()}
    assert trials["broken_fit"].status == "failed" and "no fit" in trials["broken_fit"].failed_gates[0] and not trials["broken_fit"].selected
    assert trials["bootstrap"].selected and len(trials) == 2 and out["decision"].first().generator == "bootstrap"
    assert isinstance(out["decision"].first().artifact_eligible, bool) and out["privacy"].count() == 1
    monkeypatch.setattr(jobs.val, "validation_summary", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        jobs.run_experiment_tables(df, candidates=("bootstrap",))


def test_sequence_experiment(spark):
    rows = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(np.sin(h / 3 + len(e)) + h % 5), float(h % 7)) for e in ("a", "bb") for h in range(120)]
    df = spark.createDataFrame(rows, "e string, t timestamp, x double, y double")
    spec = seq.SequenceSpec(timestamp="t", features=("x", "y"), entity="e", sequence_length=8, stride=4, test_fraction=0.2, validation_fraction=0.2)
    out = jobs.run_experiment_sequences(df, spec, forecast_target="x")
    trials = {r.generator: r for r in out["trials"].collect()}
    assert set(trials) == set(seq.SEQUENCE_GENERATORS) and sum(r.selected for r in trials.values()) == 1
    assert "exact_match" in trials["window_bootstrap"].failed_gates and "exact_match" not in trials["jittered_bootstrap"].failed_gates
    gates = out["gates"].first()
    assert gates.eligible == (not gates.failed_gates and not next(r.failed_gates for r in trials.values() if r.selected))
    assert out["forecast"].where(F.col("training") == "synthetic_only").first().mae is not None
    with pytest.raises(seq.SequenceError):
        jobs.run_experiment_sequences(df, spec, candidates=("unknown",))


def test_whole_validation_summary_frees_files_between_its_parts(spark, monkeypatch):
    """Over all rows the parts run one after the other, and each begins with the files of the last one given up."""
    from tabvet.operators import validation

    events = []
    monkeypatch.setattr(validation, "free_shuffles", lambda s: events.append("free"))
    for module, name in ((validation.fid, "correlation_score"), (validation.fid, "diversity_score"), (validation.priv, "privacy_score")):
        part = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, part=part, name=name, **kw: (events.append(name), part(*a, **kw))[1])
    real = spark.range(60).select((F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("k"))
    got = {r.metric: r.value for r in validation.validation_summary(real, real, whole_privacy=True).collect()}
    assert events == ["free", "free", "correlation_score", "free", "diversity_score", "free", "privacy_score", "free"]
    assert got["fidelity_score"] == 1.0 and got["privacy_score"] == 0.0
