"""Prediction metrics given (label, prediction[, score]) columns (survey U5, U6, U9, U12, U13).

Everything reduces to small aggregates: a confusion table grouped by
(group, y, yhat), sums of errors, or per-score counts for the rank AUC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet.functions.exprs import r6
from tabvet.operators.pairs import prefix_sum
from tabvet.session import cut_lineage


def roc_auc(df: DataFrame, label: str, score: str, by: str | None = None, weight: str | None = None) -> DataFrame:
    """Rank AUC with tied scores sharing their average rank (Mann-Whitney U). ``weight``: how many rows a row stands for.

    Scores are reduced to (score, positives, negatives) counts and ranked by a
    distributed prefix sum; null when one class is absent.
    """
    grp = F.col(by).cast("string") if by else F.lit("all")
    y = F.col(label).cast("string").try_cast("double")
    each = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    counts = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(grp.alias("_g"), F.col(score).cast("double").alias("s")).agg(
        F.sum((y == 1).cast("long") * each).alias("pos"), F.sum((y != 1).cast("long") * each).alias("neg"))
    counts = cut_lineage(counts.withColumn("cnt", F.col("pos") + F.col("neg")))  # scored once: the prefix sum reads the counts several times
    ps = prefix_sum(counts, ["_g"], "s", ["cnt"])
    ranked = ps.withColumn("avg_rank", F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0)
    agg = ranked.groupBy("_g").agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("r1"),
                                   F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    auc = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * F.col("n0"))
    out = agg.select(F.col("_g").alias("group"), F.when((F.col("n1") > 0) & (F.col("n0") > 0), r6(auc)).alias("auc"),
                     F.col("n1").cast("bigint").alias("positives"), F.col("n0").cast("bigint").alias("negatives"))
    return out if by else out.drop("group")


def _confusion(df: DataFrame, y: str, yhat: str, group: str | None = None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit("all")
    return df.groupBy(g.alias("_g"), F.col(y).cast("string").alias("y"), F.col(yhat).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))


def _macro(conf: DataFrame) -> DataFrame:
    """Per group: macro precision / recall / F1 over labels in truth or prediction, and accuracy."""
    labels = conf.select("_g", F.col("y").alias("label")).unionByName(conf.select("_g", F.col("p").alias("label"))).distinct()
    tp = conf.where(F.col("y") == F.col("p")).groupBy("_g", F.col("y").alias("label")).agg(F.sum("n").alias("tp"))
    true_n = conf.groupBy("_g", F.col("y").alias("label")).agg(F.sum("n").alias("t"))
    pred_n = conf.groupBy("_g", F.col("p").alias("label")).agg(F.sum("n").alias("q"))
    per = (labels.join(tp, ["_g", "label"], "left").join(true_n, ["_g", "label"], "left")
           .join(pred_n, ["_g", "label"], "left").fillna(0, ["tp", "t", "q"]))
    prec = F.when(F.col("q") > 0, F.col("tp") / F.col("q")).otherwise(F.lit(0.0))
    rec = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("t") + F.col("q") > 0, 2 * F.col("tp") / (F.col("t") + F.col("q"))).otherwise(F.lit(0.0))
    macro = per.groupBy("_g").agg(F.avg(prec).alias("precision"), F.avg(rec).alias("recall"), F.avg(f1).alias("f1"),
                                  F.count(F.lit(1)).alias("n_labels"))
    acc = conf.groupBy("_g").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    return macro.join(acc, "_g").withColumn("accuracy", F.col("hit") / F.col("n"))


def classification_metrics(df: DataFrame, y: str, yhat: str, score: str | None = None,
                           positive: str | None = None) -> DataFrame:
    """Accuracy, macro precision/recall/F1 (0 on empty), ROC-AUC only for exactly 2 classes.

    ``score`` is the score of the ``positive`` class (default: label 1)."""
    m = _macro(_confusion(df, y, yhat))
    out = m.select(r6(F.col("accuracy")).alias("accuracy"), r6(F.col("precision")).alias("precision_macro"),
                   r6(F.col("recall")).alias("recall_macro"), r6(F.col("f1")).alias("f1_macro"),
                   F.col("n").cast("bigint").alias("n"), r6(F.col("f1")).alias("primary_value"),
                   F.lit("f1_macro").alias("primary_metric"))
    if score is None:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    n_classes = df.where(F.col(y).isNotNull()).select(F.col(y).cast("string")).distinct().limit(3).count()
    if n_classes != 2:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    lab = y if positive is None else "_pos"
    src = df if positive is None else df.withColumn("_pos", (F.col(y).cast("string") == F.lit(positive)).cast("int"))
    auc = roc_auc(src, lab, score).select(F.col("auc").alias("roc_auc"))
    return out.crossJoin(auc)  # one-row frames


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MAE, RMSE and R^2 (primary); R^2 of a constant truth is 1 if perfect else 0."""
    e = F.col(y).cast("double") - F.col(yhat).cast("double")
    agg = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("ss_res"),
                 (F.var_pop(F.col(y).cast("double")) * F.count(F.col(y))).alias("ss_tot"), F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("ss_tot") > 0, F.lit(1.0) - F.col("ss_res") / F.col("ss_tot")).when(
        F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return agg.select(r6(F.col("mae")).alias("mae"), r6(F.col("rmse")).alias("rmse"), r6(r2).alias("r2"),
                      F.col("n").cast("bigint").alias("n"), r6(r2).alias("primary_value"), F.lit("r2").alias("primary_metric"))


def primary_improvement(baseline: float, augmented: float, task_type: str = "classification",
                        primary_metric: str = "f1_macro") -> float:
    """Relative change of the primary metric; RMSE is lower-is-better."""
    if task_type == "regression" and primary_metric == "rmse":
        if not baseline:
            return 0.0
        return (baseline - augmented) / abs(baseline)
    denom = abs(baseline) if baseline else 1.0
    return (augmented - baseline) / denom


def primary_improvement_col(baseline: F.Column, augmented: F.Column, lower_is_better: bool = False) -> F.Column:
    """U9 as a column expression."""
    if lower_is_better:
        return F.when((baseline == 0) | baseline.isNull(), F.lit(0.0)).otherwise((baseline - augmented) / F.abs(baseline))
    denom = F.when((baseline == 0) | baseline.isNull(), F.lit(1.0)).otherwise(F.abs(baseline))
    return (augmented - baseline) / denom


def group_fairness(df: DataFrame, y: str, yhat: str, group: str, task_type: str = "classification") -> DataFrame:
    """Per group n and macro F1/precision/recall; max F1 gap over groups (>= 2 groups)."""
    g = F.col(group).cast("string")
    if task_type != "classification":
        return df.groupBy(g.alias("group")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(
            "group", "n", *[F.lit(None).cast("double").alias(c) for c in ("f1", "precision", "recall", "max_gap")])
    m = _macro(_confusion(df, y, yhat, group))
    gap = m.agg(F.when(F.count(F.lit(1)) >= 2, F.max("f1") - F.min("f1")).alias("max_gap"))
    return m.crossJoin(gap).select(  # gap is one row
        F.col("_g").alias("group"), F.col("n").cast("double").alias("n"), r6(F.col("f1")).alias("f1"),
        r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"), r6(F.col("max_gap")).alias("max_gap"))
