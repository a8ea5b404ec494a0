"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabvet.operators import fidelity as fid
from tabvet.plans.fixtures import lineitem_halves, lineitem_whole

Query = Callable[[SparkSession, str], DataFrame]


def _pair(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        real, syn = lineitem_halves(spark, sf_dir)
        return fn(real, syn)
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Query] = {
    "f1_ks_statistic": _pair(fid.ks_statistic),
    "f2_total_variation": _pair(fid.total_variation),
    "f3_fidelity_columns": _pair(fid.fidelity_columns),
    "f3_fidelity_score": _pair(fid.fidelity_score),
    "f4_wasserstein": _pair(fid.wasserstein),
    "f4_distribution_score": _pair(fid.distribution_score),
    "f5_quantile_error": _pair(fid.quantile_error),
    "f6_histogram_overlap": _pair(fid.histogram_overlap),
    "f7_js_divergence": _pair(fid.js_divergence),
    "f8_correlation_score": _pair(fid.correlation_score),
    "f9_diversity_score": _pair(fid.diversity_score),
}


# ---- profile (P) and sizing (N) ---------------------------------------------

from tabvet.operators import profile as prof  # noqa: E402
from tabvet.operators import sizing  # noqa: E402
from tabvet.plans.fixtures import documents_labeled  # noqa: E402
from tabvet.sources.io import load_table  # noqa: E402


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "labeled_docs":
        return documents_labeled(spark, sf_dir)
    return load_table(spark, sf_dir, name)


def _on(name: str, fn, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(table(spark, sf_dir, name), **kw)
    run.__doc__ = fn.__doc__
    return run


LINEITEM_NUMERICAL = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
ORDERS_CATEGORICAL = ["o_orderstatus", "o_orderdate", "o_orderpriority"]

QUERIES.update({
    "p1_dataset_summary_orders": _on("orders", prof.dataset_summary),
    "p1_dataset_summary_lineitem": _on("lineitem", prof.dataset_summary),
    "p2_missing_profile_orders": _on("orders", prof.missing_profile),
    "p4_unique_counts_lineitem": _on("lineitem", prof.unique_counts),
    "p5_column_kinds_lineitem": _on("lineitem", prof.column_kinds),
    "p5_column_kinds_orders": _on("orders", prof.column_kinds),
    "p6_semantic_types_orders": _on("orders", prof.semantic_types),
    "p6_semantic_types_customer": _on("customer", prof.semantic_types),
    "p6_semantic_types_lineitem": _on("lineitem", prof.semantic_types),
    "p6_semantic_types_documents": _on("documents", prof.semantic_types),
    "p6_semantic_types_events": _on("events", prof.semantic_types),
    "p6_semantic_types_labeled_docs": _on("labeled_docs", prof.semantic_types, target="quality"),
    "p7_numeric_stats_lineitem": _on("lineitem", prof.numeric_stats),
    "p8_top_categories_orders": _on("orders", prof.top_categories),
    "p9_correlations_lineitem": _on("lineitem", prof.correlations),
    "p10_class_distribution_labels": _on("labels", prof.class_distribution, target="quality"),
    "p11_low_cardinality_lineitem": _on("lineitem", prof.low_cardinality_columns),
    "p13_infer_task_labeled_docs": _on("labeled_docs", prof.infer_task, target="quality"),
    "p13_infer_task_lineitem": _on("lineitem", prof.infer_task, target="l_extendedprice"),
    "p14_detect_issues_orders": _on("orders", prof.detect_issues),
    "p14_detect_issues_labeled_docs": _on("labeled_docs", prof.detect_issues, target="quality"),
    "p14_detect_issues_supplier": _on("supplier", prof.detect_issues),
    "p15_sdtypes_orders": _on("orders", prof.sdtype_classify),
    "p15_sdtypes_customer": _on("customer", prof.sdtype_classify),
    "p15_sdtypes_labeled_docs": _on("labeled_docs", prof.sdtype_classify),
    "n1_plan_labeled_docs": _on("labeled_docs", sizing.augmentation_plan, target="quality"),
    "n1_plan_labeled_docs_by_lang": _on("labeled_docs", sizing.augmentation_plan, target="quality", by="lang"),
    "n2_plan_supplier": _on("supplier", sizing.augmentation_plan),
    "n4_plan_supplier_ratio": _on("supplier", sizing.augmentation_plan, ratio=0.3),
})


# ---- constraints (C) --------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402
from tabvet.functions.exprs import r6  # noqa: E402

from tabvet.operators import constraints as cons  # noqa: E402
from tabvet.plans.fixtures import lineitem_full_halves  # noqa: E402


def _rules_text(rules: DataFrame) -> DataFrame:
    return rules.select("column_name", "kind", "num_value", "ts_value",
                        F.array_join("str_values", "|").alias("values_text"))


def q_constraints_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, _ = lineitem_full_halves(spark, sf_dir)
    return _rules_text(cons.discover_constraints(real))


def q_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, syn = lineitem_full_halves(spark, sf_dir)
    return cons.constraint_violations(syn, cons.discover_constraints(real))


def q_validity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, syn = lineitem_full_halves(spark, sf_dir)
    return cons.validity_score(syn, cons.discover_constraints(real))


def q_constraints_discover_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules_text(cons.discover_constraints(load_table(spark, sf_dir, "lineitem")))


QUERIES.update({
    "c1_discover_constraints_all": q_constraints_discover_all,
    "c1_discover_constraints": q_constraints_discover,
    "c2_constraint_violations": q_constraint_violations,
    "c3_validity_score": q_validity_score,
})


# ---- dependency (D1-D8) -----------------------------------------------------

from tabvet.operators import dependency as dep  # noqa: E402


def q_cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, _ = lineitem_halves(spark, sf_dir)
    return dep.cramers_v(real, ["l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"])


def q_correlation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, _ = lineitem_halves(spark, sf_dir)
    return dep.correlation_ratio(real, ["l_quantity", "l_extendedprice", "net_price"],
                                 ["l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"])


def q_spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, _ = lineitem_halves(spark, sf_dir)
    return dep.spearman_pairs(real, ["l_quantity", "l_extendedprice", "net_price"]).select(
        "a", "b", F.round("rho", 6).alias("rho"))


def q_balanced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, syn = lineitem_halves(spark, sf_dir)
    r, s = dep.balanced_samples(real, syn, cap=500, seed=42)
    return r.withColumn("src", F.lit(0)).unionByName(s.withColumn("src", F.lit(1)))


_D_CATEGORICAL = ["l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
_D_NUMERICAL = ["l_quantity", "l_extendedprice", "net_price"]

QUERIES.update({
    "d2_spearman_pairs_all": lambda spark, sf_dir: dep.spearman_pairs(lineitem_whole(spark, sf_dir), _D_NUMERICAL).select(
        "a", "b", F.round("rho", 6).alias("rho")),
    "d3_cramers_v_all": lambda spark, sf_dir: dep.cramers_v(lineitem_whole(spark, sf_dir), _D_CATEGORICAL),
    "d5_correlation_ratio_all": lambda spark, sf_dir: dep.correlation_ratio(lineitem_whole(spark, sf_dir), _D_NUMERICAL, _D_CATEGORICAL),
    "d1_pearson_similarity": _pair(dep.pearson_similarity),
    "d2_spearman_pairs": q_spearman_pairs,
    "d2_spearman_similarity": _pair(dep.spearman_similarity),
    "d3_cramers_v": q_cramers_v,
    "d4_categorical_dependency_similarity": _pair(dep.categorical_dependency_similarity),
    "d5_correlation_ratio": q_correlation_ratio,
    "d6_mixed_dependency_similarity": _pair(dep.mixed_dependency_similarity),
    "d7_dependency_similarity": _pair(dep.dependency_similarity),
    "d8_balanced_samples": q_balanced_samples,
})


# ---- privacy (V) ------------------------------------------------------------

from tabvet.operators import evaluation as ev  # noqa: E402
from tabvet.operators import privacy as priv  # noqa: E402
from tabvet.operators import splits as spl  # noqa: E402
from tabvet.plans.fixtures import labeled_predictions, lineitem_thirds, priced_lineitems  # noqa: E402


def q_distance_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, holdout, syn = lineitem_thirds(spark, sf_dir)
    return priv.distance_privacy(train, holdout, syn, cap=128, seed=42)


def q_distance_privacy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priv.distance_privacy_all(*lineitem_thirds(spark, sf_dir))


QUERIES.update({
    "v2_near_match_rate_all": _pair(lambda real, syn: priv.near_match_rate(real, syn, sample_syn=None, sample_real=None)),
    "v3_privacy_score_all": _pair(lambda real, syn: priv.privacy_score(real, syn, sample_syn=None, sample_real=None)),
    "v4_distance_privacy_all": q_distance_privacy_all,
    "v1_exact_match_rate": _pair(priv.exact_match_rate),
    "v2_near_match_rate": _pair(priv.near_match_rate),
    "v3_privacy_score": _pair(priv.privacy_score),
    "v4_distance_privacy": q_distance_privacy,
})


# ---- splits and prediction metrics (U) --------------------------------------

def q_three_way_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labeled_docs")
    return spl.three_way_split(df, "quality", test=0.25, validation=0.25, seed=42).select("doc_id", "split")


def q_three_way_unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load_table(spark, sf_dir, "orders")
    return spl.three_way_split(df, None, test=0.2, validation=0.25, seed=7).select("o_orderkey", "split")


def q_two_way_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load_table(spark, sf_dir, "lineitem")
    s = spl.two_way_split(df, "l_returnflag", test=0.25, seed=42)
    return s.groupBy("split", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def q_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.classification_metrics(labeled_predictions(spark, sf_dir), "quality", "predicted", score="n_chars")


def q_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.regression_metrics(priced_lineitems(spark, sf_dir), "l_extendedprice", "estimate")


def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.roc_auc(labeled_predictions(spark, sf_dir), "quality", "n_chars")


def q_roc_auc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.roc_auc(labeled_predictions(spark, sf_dir), "quality", "n_chars", by="lang")


def q_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.group_fairness(labeled_predictions(spark, sf_dir), "quality", "predicted", "lang")


def q_primary_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9 over per-language F1: baseline = rule on n_chars, augmented = rule on toxic."""
    df = labeled_predictions(spark, sf_dir).withColumn("alt", F.col("toxic"))
    base = ev.group_fairness(df, "quality", "predicted", "lang").select("group", F.col("f1").alias("baseline"))
    aug = ev.group_fairness(df, "quality", "alt", "lang").select("group", F.col("f1").alias("augmented"))
    j = base.join(aug, "group")
    return j.select("group", "baseline", "augmented",
                    F.round(ev.primary_improvement_col(F.col("baseline"), F.col("augmented")), 6).alias("improvement"))


QUERIES.update({
    "u1_three_way_split_labeled": q_three_way_labeled,
    "u2_two_way_split_lineitem": q_two_way_lineitem,
    "u3_three_way_split_unlabeled": q_three_way_unlabeled,
    "u5_classification_metrics": q_classification,
    "u6_regression_metrics": q_regression,
    "u9_primary_improvement": q_primary_improvement,
    "u12_roc_auc": q_roc_auc,
    "u12_roc_auc_by_lang": q_roc_auc_by_lang,
    "u13_group_fairness": q_fairness,
})


# ---- generation (G) ---------------------------------------------------------

from tabvet.operators import generate as gen  # noqa: E402


def q_bootstrap_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders")
    n = orders.count() // 2
    return gen.bootstrap_sample(orders, n, seed=42)


def q_bootstrap_orders_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders")
    n = orders.count() // 4
    return gen.bootstrap_sample(orders, n, seed=42, where={"o_orderstatus": "F"})


def q_copula_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lineitem_whole(spark, sf_dir)
    model = gen.copula_fit(real)
    return gen.copula_sample(spark, model, real.count(), seed=42)


def q_copula_lineitem_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lineitem_whole(spark, sf_dir)
    model = gen.copula_fit(real)
    return gen.copula_sample(spark, model, real.count() // 4, seed=42, where={"l_returnflag": "R"})


def q_codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of orders, encoded and decoded: must equal the table."""
    enc, state = gen.mixed_encode(load_table(spark, sf_dir, "orders"))
    back = gen.mixed_decode(enc, state)
    return back.withColumn("o_totalprice", r6(F.col("o_totalprice")))


def q_mixed_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per vocabulary code of every categorical column of orders."""
    enc, state = gen.mixed_encode(load_table(spark, sf_dir, "orders"))
    codes = enc.unpivot([], [F.col(c) for c in state.categorical], "column_name", "code")
    return codes.groupBy("column_name", "code").agg(F.count(F.lit(1)).alias("n"))


QUERIES.update({
    "g1_bootstrap_orders": q_bootstrap_orders,
    "g2_bootstrap_orders_where": q_bootstrap_orders_where,
    "g4_copula_sample_lineitem": q_copula_lineitem,
    "g5_copula_sample_lineitem_where": q_copula_lineitem_where,
    "g9_mixed_encode_orders": q_mixed_encode,
    "g10_codec_round_trip_orders": q_codec_round_trip,
})


# ---- sequences (T) ----------------------------------------------------------

from tabvet.operators import sequences as seq  # noqa: E402
from tabvet.plans.fixtures import event_grid  # noqa: E402
from tabvet.session import cut_lineage  # noqa: E402

GRID_SPEC = seq.SequenceSpec(timestamp="hour", features=("n_events", "value_sum"), entity="event_type",
                             sequence_length=24, stride=6, test_fraction=0.2, validation_fraction=0.2)
RAW_SPEC = seq.SequenceSpec(timestamp="ts", features=("value",), entity="event_type", sequence_length=24)


def _grid_windows(spark, sf_dir):
    return seq.prepare_sequences(event_grid(spark, sf_dir), GRID_SPEC)


def q_profile_raw(spark, sf_dir):
    # raw events: an event type may have several at one time, as its SQL counts them
    return seq.profile_sequences(load_table(spark, sf_dir, "events"), RAW_SPEC, repeated="count").entities


def q_profile_grid(spark, sf_dir):
    return seq.profile_sequences(event_grid(spark, sf_dir), GRID_SPEC).entities


def q_chrono_split(spark, sf_dir):
    s = seq.chronological_split(event_grid(spark, sf_dir), GRID_SPEC)
    return s.groupBy(F.col("_entity").alias("entity"), "split").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.timestamp_micros(F.min("_t")).alias("first_hour"),
        F.timestamp_micros(F.max("_t")).alias("last_hour"))


def q_scaler(spark, sf_dir):
    p = _grid_windows(spark, sf_dir)
    s = p.scaler
    return spark.createDataFrame([(f, float(lo), float(sp), float(md)) for f, lo, sp, md in
                                  zip(s.features, s.minimum, s.span, s.training_median)],
                                 "feature string, minimum double, span double, training_median double")


def q_windows(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    return w.select("split", "entity", "start", F.element_at("timestamps", 1).alias("first_ts"),
                    F.element_at("timestamps", -1).alias("last_ts"), F.size("values").cast("bigint").alias("n_steps"),
                    F.round(F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x), 6).alias("value_total"))


def q_windows_to_rows(spark, sf_dir):
    p = _grid_windows(spark, sf_dir)
    return seq.windows_to_rows(p.windows.where(F.col("split") == "validation"), GRID_SPEC, p.scaler, p.interval_us)


def q_windows_to_rows_all(spark, sf_dir):
    p = _grid_windows(spark, sf_dir)
    return seq.windows_to_rows(p.windows, GRID_SPEC, p.scaler, p.interval_us)


def q_window_bootstrap(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    train = w.where(F.col("split") == "train")
    n = w.where(F.col("split") == "test").count()
    return seq.window_bootstrap(train, n, seed=42).select("draw", "source_window_id")


def q_sequence_metrics(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    per, _ = seq.sequence_metrics(w.where(F.col("split") == "train"), w.where(F.col("split") == "test"), 2, 24)
    return per


def q_sequence_summary(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    _, summary = seq.sequence_metrics(w.where(F.col("split") == "train"), w.where(F.col("split") == "test"), 2, 24)
    return summary


def q_sequence_privacy(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    train = w.where(F.col("split") == "train")
    syn = seq.window_bootstrap(train, w.where(F.col("split") == "test").count(), seed=42)
    return seq.sequence_distance_privacy(train, w.where(F.col("split") == "validation"), syn, cap=128, seed=42)


def q_sequence_privacy_all(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    train = w.where(F.col("split") == "train")
    syn = cut_lineage(seq.window_bootstrap(train, w.where(F.col("split") == "test").count(), seed=42))
    return seq.sequence_distance_privacy_all(train, w.where(F.col("split") == "validation"), syn)


def q_temporal_gates_all(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    train, val = w.where(F.col("split") == "train"), w.where(F.col("split") == "validation")
    syn = cut_lineage(seq.window_bootstrap(train, w.where(F.col("split") == "test").count(), seed=42))
    per, _ = seq.sequence_metrics(val, syn, 2, 24)
    return seq.temporal_gates(per, seq.sequence_distance_privacy_all(train, val, syn))


def q_temporal_gates(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    train = w.where(F.col("split") == "train")
    syn = seq.window_bootstrap(train, w.where(F.col("split") == "test").count(), seed=42)
    per, _ = seq.sequence_metrics(w.where(F.col("split") == "validation"), syn, 2, 24)
    priv = seq.sequence_distance_privacy(train, w.where(F.col("split") == "validation"), syn, cap=128, seed=42)
    return seq.temporal_gates(per, priv)


QUERIES.update({
    "t2_profile_events_raw": q_profile_raw,
    "t2_profile_event_grid": q_profile_grid,
    "t4_chronological_split": q_chrono_split,
    "t6_scaler": q_scaler,
    "t7_sliding_windows": q_windows,
    "t9_windows_to_rows": q_windows_to_rows,
    "t9_windows_to_rows_all": q_windows_to_rows_all,
    "t10_window_bootstrap": q_window_bootstrap,
    "t11_t15_sequence_metrics": q_sequence_metrics,
    "t15_t16_sequence_summary": q_sequence_summary,
    "v5_sequence_distance_privacy": q_sequence_privacy,
    "v5_sequence_distance_privacy_all": q_sequence_privacy_all,
    "t18_temporal_gates_all": q_temporal_gates_all,
    "t18_temporal_gates": q_temporal_gates,
})


# ---- text (X), gates and selection (R), sources (S) --------------------------

from tabvet.operators import select as sel  # noqa: E402
from tabvet.operators import text as txt  # noqa: E402
from tabvet.plans.fixtures import source_candidates  # noqa: E402
from tabvet.sources import io as sio  # noqa: E402

ORDER_TEMPLATE = "Order {record_id} for customer {o_custkey}: "
ORDER_FIELDS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
STATUS_RULES = {"o_orderstatus": {"F": "o_orderstatus=F", "O": "o_orderstatus=O", "P": "pending"}}


def _rendered(spark, sf_dir):
    orders = load_table(spark, sf_dir, "orders")
    return txt.render_text(orders, ORDER_TEMPLATE, ORDER_FIELDS, record_id="o_orderkey").join(
        orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")


def q_render(spark, sf_dir):
    return _rendered(spark, sf_dir).select("o_orderkey", "text")


def q_consistency(spark, sf_dir):
    per = txt.text_consistency(_rendered(spark, sf_dir), "text", txt.rules_frame(spark, STATUS_RULES), "o_orderkey")
    return per.select("o_orderkey", F.array_join("matched_fields", ",").alias("matched"),
                      F.size("violations").cast("bigint").alias("n_violations"), "consistent")


def q_consistency_summary(spark, sf_dir):
    per = txt.text_consistency(_rendered(spark, sf_dir), "text", txt.rules_frame(spark, STATUS_RULES), "o_orderkey")
    return txt.consistency_summary(per)


def q_run_gates(spark, sf_dir):
    g = sel.run_gates(source_candidates(spark, sf_dir))
    return g.select("candidate_id", F.array_join("failed_gates", ",").alias("failed"), "artifact_eligible")


def q_hard_gates(spark, sf_dir):
    g = sel.hard_gates(source_candidates(spark, sf_dir))
    return g.select("candidate_id", "passed_hard_gates", "failure_reason")


def q_pareto(spark, sf_dir):
    return sel.pareto_frontier(source_candidates(spark, sf_dir), "labeled").select("candidate_id", "pareto_optimal", "priority")


def q_select(spark, sf_dir):
    return sel.select_candidate(source_candidates(spark, sf_dir), "labeled").select("candidate_id", "priority", "selected")


def q_quality_cost(spark, sf_dir):
    c = sel.hard_gates(source_candidates(spark, sf_dir)).select(
        F.col("candidate_id").alias("generator"), F.lit("completed").alias("status"),
        F.col("distribution_score").alias("validation_score"), "cost_seconds", "failed_gates")
    return sel.select_quality_cost(c, 0.05).select("generator", "pareto_optimal", "selected", "quality_gates_passed")


def q_fingerprint(spark, sf_dir):
    return sio.dataset_fingerprint(load_table(spark, sf_dir, "lineitem"), "source", 42).select(
        "dataset_hash", "num_rows", "columns", "generator", "random_seed")


def q_preview(spark, sf_dir):
    return sio.preview(load_table(spark, sf_dir, "orders"), ["o_orderkey"], 10)


def q_read_validate(spark, sf_dir):
    df = sio.validate_table(sio.read_table(spark, f"{sf_dir}/lineitem.parquet"))
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


QUERIES.update({
    "x1_render_text_orders": q_render,
    "x2_text_consistency_orders": q_consistency,
    "x2_consistency_summary_orders": q_consistency_summary,
    "r1_run_gates": q_run_gates,
    "r2_hard_gates": q_hard_gates,
    "r3_pareto_frontier": q_pareto,
    "r4_select_candidate": q_select,
    "r5_select_quality_cost": q_quality_cost,
    "s2_read_validate_lineitem": q_read_validate,
    "s9_preview_orders": q_preview,
    "s10_fingerprint_lineitem": q_fingerprint,
})


# ---- flagship: bootstrap lineitem, then validate it (G1 + F10 + V3 + C3) ----

from tabvet.operators import validation as val  # noqa: E402
from tabvet.operators.pairs import column_kinds_of  # noqa: E402
from tabvet.plans.fixtures import PAIR_COLUMNS  # noqa: E402


def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap half as many rows as the real half of lineitem and report every quality metric."""
    real, _ = lineitem_halves(spark, sf_dir)
    n = max(1, real.count() // 2)
    kinds = column_kinds_of(real)  # one distinct-count pass, shared by generator and metrics
    # the synthetic table is written once; every metric below reads it
    syn = cut_lineage(gen.bootstrap_sample(real, n, seed=42, numerical=kinds[0]).drop("_draw").select(*PAIR_COLUMNS))
    return val.validation_summary(real, syn, seed=42, kinds=kinds)


def q_flagship_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap half as many rows as lineitem has and report every quality metric over all rows of both."""
    real = lineitem_whole(spark, sf_dir)
    kinds = column_kinds_of(real)
    syn = gen.bootstrap_sample(real, max(1, real.count() // 2), seed=42, numerical=kinds[0]).drop("_draw").select(*PAIR_COLUMNS)  # written already
    return val.validation_summary(real, syn, seed=42, kinds=kinds, whole_privacy=True)


QUERIES["f10_validation_summary_bootstrap"] = q_flagship
QUERIES["f10_validation_summary_all"] = q_flagship_all


# ---- MLlib diagnostics and downstream utility (D9-D14, U4, U7, U8, U10, U11, T17) ----

from pyspark.ml.functions import vector_to_array  # noqa: E402

from tabvet.operators import models as mdl  # noqa: E402


def _syn_bootstrap(spark, sf_dir):
    """The whole of lineitem and a bootstrap of half as many rows."""
    real = lineitem_whole(spark, sf_dir)
    syn = gen.bootstrap_sample(real, max(1, real.count() // 2), seed=7).drop("_draw")
    return real, syn


def q_mixed_features(spark, sf_dir):
    """Every row of lineitem as a feature vector."""
    li = load_table(spark, sf_dir, "lineitem").withColumn("net_price", F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))
    whole = li.select(*PAIR_COLUMNS)
    fm = mdl.fit_features(whole, ["l_quantity", "l_extendedprice", "net_price"], ["l_discount", "l_returnflag", "l_linestatus"])
    return fm.transform(whole).select(vector_to_array("features").alias("features"))


def _docs_split(spark, sf_dir):
    df = table(spark, sf_dir, "labeled_docs").drop("doc_id", "toxic")
    s = spl.two_way_split(df, "quality", test=0.25, seed=42)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def q_evaluate_split(spark, sf_dir):
    train, test = _docs_split(spark, sf_dir)
    return mdl.evaluate_split(train, test, "quality", "classification", model="random_forest")


def q_evaluate_regression(spark, sf_dir):
    df = priced_lineitems(spark, sf_dir).select("l_quantity", "p_retailprice", "l_extendedprice")
    s = spl.two_way_split(df, "l_extendedprice", test=0.25, seed=42)
    return mdl.evaluate_split(s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split"),
                              "l_extendedprice", "regression", model="ridge")


def q_compare_augmentation(spark, sf_dir):
    train, test = _docs_split(spark, sf_dir)
    syn = gen.bootstrap_sample(train, max(1, train.count() // 2), seed=9).drop("_draw")
    return mdl.compare_augmentation(train, test, syn, "quality", "classification")


def q_cross_validate(spark, sf_dir):
    train, _ = _docs_split(spark, sf_dir)
    return mdl.cross_validate(train, "quality", "classification", folds=3)


def q_real_vs_synthetic(spark, sf_dir):
    train, test = _docs_split(spark, sf_dir)
    syn = gen.bootstrap_sample(train, train.count(), seed=11).drop("_draw")
    return mdl.train_real_vs_synthetic(train, test, syn, "quality", "classification")


def q_forecast(spark, sf_dir):
    p = _grid_windows(spark, sf_dir)
    w = p.windows
    train = w.where(F.col("split") == "train")
    syn = seq.window_bootstrap(train, train.count(), seed=42).select("window_id", "values")
    return seq.forecast_utility(train.select("window_id", "values"), w.where(F.col("split") == "test").select("window_id", "values"),
                                syn, target_index=0, horizon=2, span=p.scaler.span[0], length=GRID_SPEC.sequence_length)


QUERIES.update({
    "d9_mixed_features_lineitem": q_mixed_features,
    "d10_mmd_lineitem": lambda spark, sf_dir: mdl.mmd(*_syn_bootstrap(spark, sf_dir), cap=500),
    "d10_mmd_rff_lineitem": lambda spark, sf_dir: mdl.mmd(*_syn_bootstrap(spark, sf_dir), cap=None),
    "d11_discriminator_ensemble_lineitem": lambda spark, sf_dir: mdl.discriminator_ensemble(*_syn_bootstrap(spark, sf_dir)),
    "d12_pca_structure_lineitem": lambda spark, sf_dir: mdl.pca_structure_score(*_syn_bootstrap(spark, sf_dir)),
    "d13_knn_discriminator_lineitem": lambda spark, sf_dir: mdl.knn_discriminator(*_syn_bootstrap(spark, sf_dir)),
    "d14_unsupervised_utility_lineitem": lambda spark, sf_dir: mdl.unsupervised_utility(*_syn_bootstrap(spark, sf_dir)),
    "u7_evaluate_split_labeled_docs": q_evaluate_split,
    "u7_evaluate_split_regression": q_evaluate_regression,
    "u8_compare_augmentation": q_compare_augmentation,
    "u10_cross_validate": q_cross_validate,
    "u11_train_real_vs_synthetic": q_real_vs_synthetic,
    "t17_forecast_utility": q_forecast,
})


# ---- end-to-end jobs (R6-R8) -------------------------------------------------

from tabvet.plans import jobs as pipe  # noqa: E402


def q_run_end_to_end(spark, sf_dir):
    df = table(spark, sf_dir, "labeled_docs").drop("doc_id")
    res = pipe.run_end_to_end(df, "quality", candidates=("bootstrap", "gaussian_copula"), group="lang")
    return res.trials.withColumn("decision", F.lit(res.decision)).withColumn("selected", F.col("candidate") == F.lit(res.selected))


def q_run_experiment_tables(spark, sf_dir):
    df = table(spark, sf_dir, "labeled_docs").drop("doc_id")
    out = pipe.run_experiment_tables(df, "quality", group="lang")
    return out["trials"]


def q_run_experiment_sequences(spark, sf_dir):
    out = pipe.run_experiment_sequences(event_grid(spark, sf_dir), GRID_SPEC, forecast_target="n_events")
    return out["gates"].crossJoin(out["summary"])  # two one-row frames


QUERIES.update({
    "r6_run_end_to_end_labeled_docs": q_run_end_to_end,
    "r7_run_experiment_tables": q_run_experiment_tables,
    "r8_run_experiment_sequences": q_run_experiment_sequences,
})


# ---- reports, records, generator inputs (F7, F11, S4, S5, S12, P16, G6, G11, T5, T8, T10, T18) ----

import uuid  # noqa: E402
from dataclasses import replace  # noqa: E402

from tabvet.functions.exprs import seeded_uniform  # noqa: E402
from tabvet.operators.pairs import INTEGER_TYPES, is_numeric_type, schema_types  # noqa: E402
from tabvet.plans.fixtures import run_events  # noqa: E402
from tabvet.session import checkpoint_dir  # noqa: E402


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


def q_distribution_report(spark, sf_dir):
    """A synthetic half without l_tax, and with nothing in net_price and l_linestatus."""
    real, syn = lineitem_halves(spark, sf_dir)
    nothing = {"net_price": F.lit(None).cast("double"), "l_linestatus": F.lit(None).cast("string")}
    return fid.distribution_report(real, syn.drop("l_tax").withColumns(nothing))


def q_csv_round_trip(spark, sf_dir):
    """The whole of orders written as CSV and read with its schema."""
    orders = load_table(spark, sf_dir, "orders")
    return sio.read_table(spark, sio.write_table(orders, _new_path(spark, "orders.csv"), fmt="csv"), orders.schema)


def q_run_record(spark, sf_dir):
    """The record of a run over lineitem with the table's fingerprint, read back."""
    path = _new_path(spark, "runs")
    seen = sio.dataset_fingerprint(load_table(spark, sf_dir, "lineitem"), "source", 42).first()
    sio.write_run_record(spark, path, "run-1", "completed", {"table": "lineitem", "rows": seen["num_rows"]}, str(seen["dataset_hash"]))
    return sio.read_run_records(spark, path).select("run_id", "status", "config", "dataset_hash")


def q_split_ids(spark, sf_dir):
    """The parts of the labelled documents, written by part and read back."""
    path = sio.write_split_ids(q_three_way_labeled(spark, sf_dir), _new_path(spark, "split"), ["doc_id"])
    return spark.read.parquet(path).select("doc_id", "split")


def q_run_log_recovered(spark, sf_dir):
    """Runs per status after the open ones were marked as failed in the written log."""
    path = _new_path(spark, "log")
    run_events(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")).write.parquet(path)
    sio.run_log_recover(spark, path)
    return sio.run_log_latest(spark.read.parquet(path)).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def q_align_output(spark, sf_dir):
    """Orders with columns in another order, numbers as text and a further column, brought back to their schema."""
    orders = load_table(spark, sf_dir, "orders")
    types = schema_types(orders)
    loose = orders.select(*[F.col(c).cast("string").alias(c) if is_numeric_type(types[c]) else F.col(c) for c in reversed(orders.columns)],
                          F.lit(1).alias("extra"))
    return gen.align_output(loose, orders, n_expected=orders.count())


def _range_fit(df: DataFrame):
    bounds = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in df.columns for f in (F.min, F.max)]).first()
    return [(c, schema_types(df)[c], bounds[f"min_{c}"], bounds[f"max_{c}"]) for c in df.columns]


def _range_sample(spark: SparkSession, params, n: int, seed: int, where) -> DataFrame:
    def column(c, dtype, low, high):
        x = F.lit(float(low)) + seeded_uniform(seed, F.col("id"), f"range:{c}") * F.lit(float(high) - float(low))
        return (F.rint(x) if isinstance(dtype, INTEGER_TYPES) else x).cast(dtype).alias(c)

    return spark.range(n).select(*[column(*p) for p in params])


def q_registered_generator(spark, sf_dir):
    """A user's own generator (uniform between each column's least and greatest value), registered, fitted and sampled by name."""
    orders = load_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    try:
        gen.get_generator("uniform_range")
    except gen.GeneratorError:
        gen.register_generator("uniform_range", _range_fit, _range_sample)
    return gen.generate("uniform_range", orders, orders.count(), 42)


def q_fill_missing(spark, sf_dir):
    """Hours without events get the training median."""
    spec = replace(GRID_SPEC, missing_policy="training_median")
    filled, _ = seq.fill_missing(seq.chronological_split(event_grid(spark, sf_dir, fill=False), spec), spec)
    return filled.select(F.col("_entity").alias("entity"), F.timestamp_micros("_t").alias("hour"), "split", "n_events", "value_sum")


def q_inverse_scale(spark, sf_dir):
    p = _grid_windows(spark, sf_dir)

    def total(i: int):
        return F.round(F.aggregate("values", F.lit(0.0), lambda a, step: a + step[i]), 4)

    return seq.inverse_scale(p.windows, p.scaler).select("split", "entity", "start", total(0).alias("events_total"), total(1).alias("value_total"))


def q_jittered_bootstrap(spark, sf_dir):
    w = _grid_windows(spark, sf_dir).windows
    drawn = seq.jittered_bootstrap(w.where(F.col("split") == "train"), w.where(F.col("split") == "test").count(), seed=42)
    return drawn.select("draw", "source_window_id", F.round(F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x), 4).alias("value_total"))


def q_temporal_gates_forecast(spark, sf_dir):
    """The gates over all windows with the score from forecasting validation windows."""
    p = _grid_windows(spark, sf_dir)
    train, val = (p.windows.where(F.col("split") == s) for s in ("train", "validation"))
    syn = cut_lineage(seq.window_bootstrap(train, p.windows.where(F.col("split") == "test").count(), seed=42))
    per, _ = seq.sequence_metrics(val, syn, 2, 24)
    forecast = seq.forecast_utility(train, val, syn, target_index=0, horizon=2, span=p.scaler.span[0], length=GRID_SPEC.sequence_length)
    return seq.temporal_gates(per, seq.sequence_distance_privacy_all(train, val, syn), forecast)


QUERIES.update({
    "f7_distribution_report": q_distribution_report,
    "f11_class_shares": _pair(lambda real, syn: fid.class_share_comparison(real, syn, "l_returnflag")),
    "f11_histograms": _pair(fid.histogram_comparison),
    "f11_correlation_matrices": _pair(fid.correlation_comparison),
    "s4_csv_round_trip_orders": q_csv_round_trip,
    "s5_run_record_lineitem": q_run_record,
    "s5_split_ids_labeled": q_split_ids,
    "s12_run_log_latest": lambda spark, sf_dir: sio.run_log_latest(run_events(spark, sf_dir)),
    "s12_run_log_list": lambda spark, sf_dir: sio.run_log_list(run_events(spark, sf_dir), 50),
    "s12_run_log_recovered": q_run_log_recovered,
    "p16_generator_input_lineitem": _on("lineitem", prof.validate_generator_input),
    "g6_align_output_orders": q_align_output,
    "g11_registered_generator_orders": q_registered_generator,
    "t5_fill_missing": q_fill_missing,
    "t8_inverse_scale": q_inverse_scale,
    "t10_jittered_bootstrap": q_jittered_bootstrap,
    "t18_temporal_gates_forecast": q_temporal_gates_forecast,
})
