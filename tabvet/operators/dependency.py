"""Dependency and multivariate similarity (survey D1-D8; MLlib parts in models.py).

Pairwise statistics over d columns are computed in one job each: pairs are
stacked into a long frame keyed by the pair, so the work is one shuffle no
matter how many pairs there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.functions.exprs import as_category, r6, row_key, seeded_uniform
from tabvet.operators.fidelity import pearson_pairs
from tabvet.operators.pairs import join_scores, long_numeric, prefix_sum, shared_kinds
from tabvet.session import cut_lineage

# Fixed value: per-table sample cap of the sampled diagnostics.
EVALUATION_SAMPLE_CAP = 500


def _similarity(diffs: DataFrame, name: str) -> DataFrame:
    """1 - mean |delta| clipped to [0, 1]; null when there is no pair."""
    return diffs.agg(
        F.when(F.count(F.lit(1)) > 0,
               r6(F.least(F.greatest(F.lit(1.0) - F.avg("d"), F.lit(0.0)), F.lit(1.0)))).alias(name),
        F.count(F.lit(1)).cast("bigint").alias("n_pairs"))


def pearson_similarity(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """1 - mean |rho_real - rho_syn| over numerical pairs (null if < 2 columns)."""
    numerical, _ = shared_kinds(real, syn, kinds)
    pr = pearson_pairs(real, numerical).withColumnRenamed("rho", "r")
    ps = pearson_pairs(syn, numerical).withColumnRenamed("rho", "s")
    return _similarity(pr.join(ps, ["a", "b"]).select(F.abs(F.col("r") - F.col("s")).alias("d")), "pearson_similarity")


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide frame (<col>...) of average ranks (ties share the mean rank; null and NaN have none).

    Values are reduced to per-value counts, a distributed prefix sum gives
    the rank range of each value, and each column's ranks are joined to the rows by value.
    """
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    vc = cut_lineage(long_numeric(wide, columns).groupBy("col", "v").agg(F.count(F.lit(1)).alias("cnt")))
    ps = prefix_sum(vc, ["col"], "v", ["cnt"])
    ranks = ps.select("col", "v", (F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0).alias("score"))
    return join_scores(wide, ranks, columns)


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) Spearman, pairwise-complete (ranks re-taken per pair when nulls exist)."""
    cols = list(columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, rho double")
    nulls = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    clean = [c for c in cols if nulls[c] == 0]
    out = pearson_pairs(average_ranks(df, clean), clean) if len(clean) >= 2 else None
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if a in clean and b in clean:
                continue
            sub = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double"))
                           & ~F.isnan(F.col(b).cast("double")))
            pr = pearson_pairs(average_ranks(sub, [a, b]), [a, b])
            out = pr if out is None else out.unionByName(pr)
    return out


def spearman_similarity(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """Like D1 with average ranks."""
    numerical, _ = shared_kinds(real, syn, kinds)
    if len(numerical) < 2:
        return _similarity(real.sparkSession.createDataFrame([], "d double"), "spearman_similarity")
    sr = spearman_pairs(real, numerical).withColumnRenamed("rho", "r")
    ss = spearman_pairs(syn, numerical).withColumnRenamed("rho", "s")
    return _similarity(sr.join(ss, ["a", "b"]).select(F.abs(F.col("r") - F.col("s")).alias("d")), "spearman_similarity")


def _pair_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, va, vb, n): crosstab cells of every categorical pair, null as 'nan'."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    cat = df.select(*[as_category(F.col(c)).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb"))
                    for a, b in pairs])
    return cat.select(F.explode(arr).alias("p")).select("p.*").groupBy("a", "b", "va", "vb").agg(
        F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D3: (a, b, cramers_v) per categorical pair; uncorrected; 0 with < 2 levels.

    chi2 = n * (sum O^2 / (R * C) - 1), so the empty cells are never needed.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, cramers_v double")
    cells = _pair_cells(df, columns)
    rows = cells.groupBy("a", "b", "va").agg(F.sum("n").alias("R"))
    colsum = cells.groupBy("a", "b", "vb").agg(F.sum("n").alias("C"))
    j = cells.join(rows, ["a", "b", "va"]).join(colsum, ["a", "b", "vb"])
    per = j.groupBy("a", "b").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("R") * F.col("C"))).alias("s"), F.sum("n").alias("tot"),
        F.count_distinct("va").alias("r"), F.count_distinct("vb").alias("c"))
    k = F.least(F.col("r"), F.col("c")) - 1
    chi2_n = F.col("s") - 1  # chi2 / n
    v = F.when((F.col("r") < 2) | (F.col("c") < 2), F.lit(0.0)).otherwise(F.sqrt(F.greatest(chi2_n, F.lit(0.0)) / k))
    return per.select("a", "b", r6(v).alias("cramers_v"))


def categorical_dependency_similarity(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """1 - mean |V_real - V_syn| over categorical pairs."""
    _, categorical = shared_kinds(real, syn, kinds)
    vr = cramers_v(real, categorical).withColumnRenamed("cramers_v", "r")
    vs = cramers_v(syn, categorical).withColumnRenamed("cramers_v", "s")
    return _similarity(vr.join(vs, ["a", "b"]).select(F.abs(F.col("r") - F.col("s")).alias("d")),
                       "categorical_dependency_similarity")


def correlation_ratio(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(num, cat, eta) = sqrt(SSB / SST); null category is a level, null values dropped."""
    if not numerical or not categorical:
        return df.sparkSession.createDataFrame([], "num string, cat string, eta double")
    arr = F.array(*[F.struct(F.lit(n).alias("num"), F.lit(c).alias("cat"), as_category(F.col(c)).alias("g"),
                             F.col(n).cast("double").alias("x"))
                    for n in numerical for c in categorical])
    long = df.select(F.explode(arr).alias("p")).select("p.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    groups = long.groupBy("num", "cat", "g").agg(F.count(F.lit(1)).alias("ng"), F.avg("x").alias("mg"))
    totals = long.groupBy("num", "cat").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"),
                                            F.var_pop("x").alias("vp"))
    ssb = groups.join(totals, ["num", "cat"]).groupBy("num", "cat").agg(
        F.sum(F.col("ng") * (F.col("mg") - F.col("m")) ** 2).alias("ssb"), F.count(F.lit(1)).alias("levels"),
        F.first("n").alias("n"), F.first("vp").alias("vp"))
    sst = F.col("n") * F.col("vp")
    eta = F.when((F.col("levels") < 2) | (sst <= 0), F.lit(0.0)).otherwise(F.sqrt(F.col("ssb") / sst))
    return ssb.select("num", "cat", r6(eta).alias("eta"))


def mixed_dependency_similarity(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """1 - mean |eta_real - eta_syn| over numeric x categorical pairs."""
    numerical, categorical = shared_kinds(real, syn, kinds)
    er = correlation_ratio(real, numerical, categorical).withColumnRenamed("eta", "r")
    es = correlation_ratio(syn, numerical, categorical).withColumnRenamed("eta", "s")
    # a pair missing on one side (e.g. all values null) counts as eta 0 there
    j = er.join(es, ["num", "cat"], "full").select(
        F.abs(F.coalesce(F.col("r"), F.lit(0.0)) - F.coalesce(F.col("s"), F.lit(0.0))).alias("d"))
    return _similarity(j, "mixed_dependency_similarity")


def dependency_similarity(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """Available parts of D1, D2, D4, D6 and their mean, with a status."""
    kinds = shared_kinds(real, syn, kinds)
    numerical, categorical = kinds
    parts = []
    if len(numerical) >= 2:
        parts.append(pearson_similarity(real, syn, kinds).select(F.lit("pearson_similarity").alias("part"),
                                                                  F.col("pearson_similarity").alias("value")))
        parts.append(spearman_similarity(real, syn, kinds).select(F.lit("spearman_similarity").alias("part"),
                                                                   F.col("spearman_similarity").alias("value")))
    if len(categorical) >= 2:
        parts.append(categorical_dependency_similarity(real, syn, kinds).select(
            F.lit("categorical_dependency_similarity").alias("part"), F.col("categorical_dependency_similarity").alias("value")))
    if numerical and categorical:
        parts.append(mixed_dependency_similarity(real, syn, kinds).select(
            F.lit("mixed_dependency_similarity").alias("part"), F.col("mixed_dependency_similarity").alias("value")))
    spark = real.sparkSession
    if not parts:
        return spark.createDataFrame([("overall_dependency_score", None, "not_applicable")], "part string, value double, status string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    overall = out.agg(F.lit("overall_dependency_score").alias("part"), r6(F.avg("value")).alias("value"))
    return out.unionByName(overall).withColumn("status", F.lit("computed"))


def balanced_samples(real: DataFrame, syn: DataFrame, cap: int = EVALUATION_SAMPLE_CAP, seed: int = 42,
                     columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Equal-size seeded samples, k = min(n_real, n_syn, cap), shared columns.

    Rows are ordered by a seeded md5 of their content and the first k kept
    (a top-k, so each task keeps at most k rows before the final merge).
    """
    cols = list(columns) if columns is not None else [c for c in real.columns if c in syn.columns]
    n = min(real.limit(cap).count(), syn.limit(cap).count(), cap)

    def take(df, tag):
        keyed = df.select(*cols).withColumn("_u", seeded_uniform(seed, row_key(df.select(*cols)), tag))
        return keyed.orderBy("_u", *cols).limit(n).drop("_u")

    return take(real, "sample"), take(syn, "sample")
