"""Marginal fidelity and diversity (survey F1-F11).

Numeric columns: the real and synthetic values are stacked in long form,
reduced to per-value counts (partial aggregation absorbs hot values), and the
two empirical CDFs come from one distributed prefix sum.  KS, Wasserstein,
quantiles and histograms all read that one frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.functions.exprs import r6, safe_div
from tabvet.operators.pairs import (column_kinds_of, long_categorical, long_numeric, prefix_sum, shared_kinds, tagged_union)
from tabvet.session import cut_lineage, written

# Quantile grid and histogram bin count of the distribution detail.
QUANTILE_GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
HISTOGRAM_BINS = 10


def numeric_value_counts(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, v, a, b): how often value v occurs in real (a) and synthetic (b)."""
    lf = long_numeric(tagged_union(real, syn, columns), columns, extra=["src"])
    return lf.groupBy("col", "v").agg(
        F.sum(F.when(F.col("src") == 0, 1).otherwise(0)).cast("bigint").alias("a"),
        F.sum(F.when(F.col("src") == 1, 1).otherwise(0)).cast("bigint").alias("b"))


def numeric_cdfs(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, v, a, b, cum_a, cum_b, next_v, na, nb, F, G) over the merged support."""
    vc = written(numeric_value_counts(real, syn, columns))  # counted once: the size check, totals and sums all read the counts
    totals = vc.groupBy("col").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    ps = prefix_sum(vc, ["col"], "v", ["a", "b"], next_value=True)
    # one row per column: a provably small broadcast side
    return (ps.join(F.broadcast(totals), "col")
            .withColumn("F", safe_div(F.col("cum_a"), F.col("na")))
            .withColumn("G", safe_div(F.col("cum_b"), F.col("nb"))))


def _real_std(real: DataFrame, columns: Sequence[str]) -> DataFrame:
    lf = long_numeric(real, columns)
    return lf.groupBy("col").agg(F.stddev_pop("v").alias("std_real"))


def ks_statistic(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """(column, ks_statistic, n_real, n_syn) per numerical column with >= 2 values each side."""
    numerical, _ = shared_kinds(real, syn, kinds)
    cdf = numeric_cdfs(real, syn, numerical)
    return (cdf.groupBy("col").agg(F.max(F.abs(F.col("F") - F.col("G"))).alias("ks"),
                                   F.first("na").alias("na"), F.first("nb").alias("nb"))
            .where((F.col("na") >= 2) & (F.col("nb") >= 2))
            .select(F.col("col").alias("column_name"), r6(F.col("ks")).alias("ks_statistic"),
                    F.col("na").cast("bigint").alias("n_real"), F.col("nb").cast("bigint").alias("n_syn")))


def category_shares(real: DataFrame, syn: DataFrame, columns: Sequence[str], keep_null: bool = True) -> DataFrame:
    """(col, v, a, b, na, nb, p, q): shares of each category on both sides."""
    lf = long_categorical(tagged_union(real, syn, columns), columns, extra=["src"], keep_null=keep_null)
    vc = cut_lineage(lf.groupBy("col", "v").agg(
        F.sum(F.when(F.col("src") == 0, 1).otherwise(0)).cast("bigint").alias("a"),
        F.sum(F.when(F.col("src") == 1, 1).otherwise(0)).cast("bigint").alias("b")))
    totals = vc.groupBy("col").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return (vc.join(F.broadcast(totals), "col")
            .withColumn("p", F.coalesce(safe_div(F.col("a"), F.col("na")), F.lit(0.0)))
            .withColumn("q", F.coalesce(safe_div(F.col("b"), F.col("nb")), F.lit(0.0))))


def total_variation(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """(column, total_variation) per categorical column; null is a category."""
    _, categorical = shared_kinds(real, syn, kinds)
    sh = category_shares(real, syn, categorical, keep_null=True)
    return sh.groupBy("col").agg((F.lit(0.5) * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tv")).select(
        F.col("col").alias("column_name"), r6(F.col("tv")).alias("total_variation"))


def fidelity_columns(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """Per-column fidelity: 1 - KS for numerical, 1 - TV for categorical."""
    kinds = shared_kinds(real, syn, kinds)
    ks = ks_statistic(real, syn, kinds).select(
        "column_name", F.lit("numerical").alias("kind"), (F.lit(1.0) - F.col("ks_statistic")).alias("raw"))
    tv = total_variation(real, syn, kinds).select(
        "column_name", F.lit("categorical").alias("kind"), (F.lit(1.0) - F.col("total_variation")).alias("raw"))
    both = ks.unionByName(tv)
    return both.select("column_name", "kind", r6(F.least(F.greatest(F.col("raw"), F.lit(0.0)), F.lit(1.0))).alias("score"))


def fidelity_score(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """one row (fidelity_score, n_columns); 0 when no column qualifies."""
    cols = fidelity_columns(real, syn, kinds)
    return cols.agg(r6(F.coalesce(F.avg("score"), F.lit(0.0))).alias("fidelity_score"),
                    F.count(F.lit(1)).cast("bigint").alias("n_columns"))


def wasserstein(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """(column, wasserstein, normalized_wasserstein) per numerical column."""
    numerical, _ = shared_kinds(real, syn, kinds)
    cdf = numeric_cdfs(real, syn, numerical)
    w = cdf.groupBy("col").agg(
        F.sum(F.abs(F.col("F") - F.col("G")) * F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))).alias("w1"),
        F.first("na").alias("na"), F.first("nb").alias("nb")).where((F.col("na") >= 2) & (F.col("nb") >= 2))
    std = _real_std(real, numerical)
    scale = F.when((F.col("std_real").isNull()) | (F.col("std_real") == 0), F.lit(1.0)).otherwise(F.col("std_real"))
    return w.join(F.broadcast(std), "col").select(
        F.col("col").alias("column_name"), r6(F.col("w1")).alias("wasserstein"),
        r6(F.col("w1") / scale).alias("normalized_wasserstein"))


def distribution_score(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """mean of 1/(1+W1/sigma) (numerical) and 1-TV (categorical); 0 if none."""
    kinds = shared_kinds(real, syn, kinds)
    w = wasserstein(real, syn, kinds).select(
        (F.lit(1.0) / (F.lit(1.0) + F.col("normalized_wasserstein"))).alias("part"))
    tv = total_variation(real, syn, kinds).select(
        F.least(F.greatest(F.lit(1.0) - F.col("total_variation"), F.lit(0.0)), F.lit(1.0)).alias("part"))
    return w.unionByName(tv).agg(r6(F.coalesce(F.avg("part"), F.lit(0.0))).alias("distribution_score"),
                                 F.count(F.lit(1)).cast("bigint").alias("n_parts"))


def _order_statistics(cdf: DataFrame, side: str, probs: Sequence[float]) -> DataFrame:
    """Exact numpy-style (linear) quantiles of one side from the CDF frame.

    For each (col, p) the order statistics k = floor(h) and k + 1 with
    h = (n - 1) p are found by a range match against the cumulative counts of
    that side; the targets table (columns x probabilities) is broadcast
    (its size is fixed by the number of columns).
    """
    cnt, cum, tot = ("a", "cum_a", "na") if side == "real" else ("b", "cum_b", "nb")
    sizes = cdf.select("col", F.col(tot).alias("n")).distinct()
    targets = (sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .withColumn("h", (F.col("n") - 1) * F.col("p"))
               .withColumn("k_lo", F.floor("h").cast("bigint"))
               .withColumn("k_hi", F.least(F.col("k_lo") + 1, F.col("n") - 1))
               .withColumn("frac", F.col("h") - F.col("k_lo")))
    ks = targets.select(F.col("col").alias("kcol"), "p", F.col("k_lo").alias("k")).unionByName(
        targets.select(F.col("col").alias("kcol"), "p", F.col("k_hi").alias("k"))).distinct()
    support = cdf.where(F.col(cnt) > 0).select("col", "v", (F.col(cum) - F.col(cnt)).alias("lo"), F.col(cum).alias("hi"))
    found = support.join(F.broadcast(ks), (F.col("col") == F.col("kcol")) & (F.col("k") >= F.col("lo"))
                         & (F.col("k") < F.col("hi"))).select("col", "p", "k", "v")
    lo = found.select("col", "p", F.col("k").alias("k_lo"), F.col("v").alias("v_lo"))
    hi = found.select("col", "p", F.col("k").alias("k_hi"), F.col("v").alias("v_hi"))
    return (targets.join(lo, ["col", "p", "k_lo"]).join(hi, ["col", "p", "k_hi"])
            .select("col", "p", (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias(f"q_{side}")))


def quantile_error(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """(column, quantile_error) = mean |q_real - q_syn| over 0.1..0.9, divided by sigma."""
    numerical, _ = shared_kinds(real, syn, kinds)
    cdf = numeric_cdfs(real, syn, numerical).where((F.col("na") >= 2) & (F.col("nb") >= 2))
    qr = _order_statistics(cdf, "real", QUANTILE_GRID)
    qs = _order_statistics(cdf, "syn", QUANTILE_GRID)
    std = _real_std(real, numerical)
    scale = F.when((F.col("std_real").isNull()) | (F.col("std_real") == 0), F.lit(1.0)).otherwise(F.col("std_real"))
    return (qr.join(qs, ["col", "p"]).groupBy("col").agg(F.avg(F.abs(F.col("q_real") - F.col("q_syn"))).alias("e"))
            .join(F.broadcast(std), "col")
            .select(F.col("col").alias("column_name"), r6(F.col("e") / scale).alias("quantile_error")))


def histogram_overlap(real: DataFrame, syn: DataFrame, kinds=None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, histogram_overlap): 10 equal bins over the joint range, last bin closed."""
    numerical, _ = shared_kinds(real, syn, kinds)
    lf = long_numeric(tagged_union(real, syn, numerical), numerical, extra=["src"])
    rng = lf.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                F.sum(1 - F.col("src")).alias("na"), F.sum("src").alias("nb"))
    rng = rng.where((F.col("na") >= 2) & (F.col("nb") >= 2))
    binned = lf.join(F.broadcast(rng), "col").where(F.col("hi") > F.col("lo")).withColumn(
        "bin", F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                       F.lit(bins - 1)))
    counts = binned.groupBy("col", "bin").agg(
        F.sum(1 - F.col("src")).alias("a"), F.sum("src").alias("b"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    overlap = counts.groupBy("col").agg(
        F.sum(F.least(F.col("a") / F.col("na"), F.col("b") / F.col("nb"))).alias("ov"))
    flat = rng.where(F.col("hi") <= F.col("lo")).select("col", F.lit(1.0).alias("ov"))
    both = overlap.unionByName(flat)
    return both.select(F.col("col").alias("column_name"),
                       r6(F.least(F.greatest(F.col("ov"), F.lit(0.0)), F.lit(1.0))).alias("histogram_overlap"))


def js_divergence(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """per categorical column, null-dropped TV, JS divergence (base 2) and coverage."""
    _, categorical = shared_kinds(real, syn, kinds)
    sh = category_shares(real, syn, categorical, keep_null=False)
    m = (F.col("p") + F.col("q")) / 2

    def kl(x):
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(F.lit(0.0))

    agg = sh.groupBy("col").agg(
        (F.lit(0.5) * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tv"),
        (F.lit(0.5) * F.sum(kl("p")) + F.lit(0.5) * F.sum(kl("q"))).alias("js"),
        F.sum(F.when(F.col("q") > 0, 1).otherwise(0)).alias("nq"),
        F.sum(F.when(F.col("p") > 0, 1).otherwise(0)).alias("np"),
        F.first("na").alias("na"), F.first("nb").alias("nb"))
    return agg.where((F.col("na") > 0) & (F.col("nb") > 0)).select(
        F.col("col").alias("column_name"), r6(F.col("tv")).alias("total_variation_distance"),
        r6(F.greatest(F.col("js"), F.lit(0.0))).alias("jensen_shannon_divergence"),
        r6(F.col("nq") / F.greatest(F.col("np"), F.lit(1))).alias("category_coverage"))


def distribution_details(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """F4-F7 per column in one tidy frame (column, metric, value)."""
    kinds = shared_kinds(real, syn, kinds)
    parts = [
        ks_statistic(real, syn, kinds).select("column_name", F.lit("ks_statistic").alias("metric"), F.col("ks_statistic").alias("value")),
        wasserstein(real, syn, kinds).select("column_name", F.lit("normalized_wasserstein").alias("metric"), F.col("normalized_wasserstein").alias("value")),
        quantile_error(real, syn, kinds).select("column_name", F.lit("quantile_error").alias("metric"), F.col("quantile_error").alias("value")),
        histogram_overlap(real, syn, kinds).select("column_name", F.lit("histogram_overlap").alias("metric"), F.col("histogram_overlap").alias("value")),
    ]
    js = js_divergence(real, syn, kinds)
    for m in ("total_variation_distance", "jensen_shannon_divergence", "category_coverage"):
        parts.append(js.select("column_name", F.lit(m).alias("metric"), F.col(m).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_report(real: DataFrame, syn: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """F1, F4-F6 of the given columns from one frame of value counts: column_name, ks_statistic,
    normalized_wasserstein, quantile_error, histogram_overlap; columns with fewer than two values on a side are left out.

    The counts and their CDFs are written once; every later step reads values with
    their multiplicities, not rows. The frames joined to them have one row per column.
    """
    cdf = cut_lineage(numeric_cdfs(real, syn, columns).where((F.col("na") >= 2) & (F.col("nb") >= 2)))
    per = cdf.groupBy("col").agg(
        F.max(F.abs(F.col("F") - F.col("G"))).alias("ks"),
        F.sum(F.abs(F.col("F") - F.col("G")) * F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))).alias("w1"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), safe_div(F.sum(F.col("a") * F.col("v")), F.first("na")).alias("mean"))
    spread = cdf.join(F.broadcast(per.select("col", "mean")), "col").groupBy("col").agg(
        F.sqrt(safe_div(F.sum(F.col("a") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))), F.first("na"))).alias("std"))
    scale = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    place = F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))), F.lit(bins - 1))
    overlap = (cdf.join(F.broadcast(per.where("hi > lo").select("col", "lo", "hi")), "col").groupBy("col", place.alias("bin"))
               .agg(F.least(safe_div(F.sum("a"), F.first("na")), safe_div(F.sum("b"), F.first("nb"))).alias("shared"))
               .groupBy("col").agg(F.sum("shared").alias("overlap")))
    errors = (_order_statistics(cdf, "real", QUANTILE_GRID).join(_order_statistics(cdf, "syn", QUANTILE_GRID), ["col", "p"])
              .groupBy("col").agg(F.avg(F.abs(F.col("q_real") - F.col("q_syn"))).alias("error")))
    one_value = F.coalesce(F.col("overlap"), F.lit(1.0))
    return per.join(spread, "col").join(errors, "col").join(overlap, "col", "left").select(
        F.col("col").alias("column_name"), r6(F.col("ks")).alias("ks_statistic"), r6(F.col("w1") / scale).alias("normalized_wasserstein"),
        r6(F.col("error") / scale).alias("quantile_error"), r6(F.least(F.greatest(one_value, F.lit(0.0)), F.lit(1.0))).alias("histogram_overlap"))


def distribution_report(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """one row for each column of ``real``: column_name, kind, status and the metrics of its kind.

    Status ``missing_in_synthetic``: ``syn`` has no such column. ``not_applicable``: a numerical column
    with fewer than two values, or a categorical one without any, on either side. Else ``computed``. Metrics
    that don't belong to the kind or the status are null.
    """
    real, syn = written(real), written(syn)  # made once: kinds, numbers and classes read some columns each
    numerical, categorical = kinds if kinds is not None else column_kinds_of(real)
    listed = real.sparkSession.createDataFrame(
        [(c, kind, c in syn.columns) for kind, names in (("numerical", numerical), ("categorical", categorical)) for c in names],
        "column_name string, kind string, present boolean")
    numbers = numeric_report(real, syn, [c for c in numerical if c in syn.columns])
    classes = js_divergence(real, syn, ([], list(categorical)))
    out = listed.join(numbers, "column_name", "left").join(classes, "column_name", "left")
    done = F.coalesce(F.col("ks_statistic"), F.col("total_variation_distance")).isNotNull()
    status = (F.when(~F.col("present"), F.lit("missing_in_synthetic")).when(done, F.lit("computed")).otherwise(F.lit("not_applicable")))
    return out.select("column_name", "kind", status.alias("status"), *numbers.columns[1:], *classes.columns[1:])


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) for every column pair a < b (by position), pairwise-complete.

    One aggregate with d(d-1)/2 guarded covariance terms; undefined -> 0.
    """
    cols = list(columns)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "a string, b string, rho double")
    exprs = []
    pairs = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
            xs, ys = F.when(both, x), F.when(both, y)
            k = len(pairs)
            exprs += [F.covar_pop(xs, ys).alias(f"c{k}"), F.stddev_pop(xs).alias(f"sx{k}"), F.stddev_pop(ys).alias(f"sy{k}")]
            pairs.append((a, b))
    wide = df.agg(*exprs)
    stack = ", ".join(f"'{a}', '{b}', c{k}, sx{k}, sy{k}" for k, (a, b) in enumerate(pairs))
    long = wide.selectExpr(f"stack({len(pairs)}, {stack}) as (a, b, c, sx, sy)")
    rho = F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))
    return long.select("a", "b", F.coalesce(F.when(F.col("sx") * F.col("sy") > 0, rho), F.lit(0.0)).alias("rho"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full symmetric matrix rows (row_col, col_col, correlation) incl. diagonal."""
    pairs = pearson_pairs(df, columns)
    spark = df.sparkSession
    varies = df.agg(*[(F.max(c) > F.min(c)).alias(c) for c in columns]).first()
    # the correlation of a constant column with itself is undefined -> 0
    diag = spark.createDataFrame([(c, c, 1.0 if varies[c] else 0.0) for c in columns], "a string, b string, rho double")
    full = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    return full.unionByName(diag).select(F.col("a").alias("row_column"), F.col("b").alias("column_name"),
                                         r6(F.col("rho")).alias("correlation"))


def correlation_score(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """1 - mean |rho_real - rho_syn| over the upper triangle; 1.0 if < 2 columns."""
    numerical, _ = shared_kinds(real, syn, kinds)
    spark = real.sparkSession
    if len(numerical) < 2:
        return spark.createDataFrame([(1.0, 0, "not_applicable")], "correlation_score double, n_pairs bigint, status string")
    pr = pearson_pairs(real, numerical).withColumnRenamed("rho", "r")
    ps = pearson_pairs(syn, numerical).withColumnRenamed("rho", "s")
    d = pr.join(ps, ["a", "b"]).agg(F.avg(F.abs(F.col("r") - F.col("s"))).alias("d"), F.count(F.lit(1)).alias("n"))
    return d.select(r6(F.least(F.greatest(F.lit(1.0) - F.col("d"), F.lit(0.0)), F.lit(1.0))).alias("correlation_score"),
                    F.col("n").cast("bigint").alias("n_pairs"), F.lit("computed").alias("status"))


def diversity_score(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """unique_ratio, category_coverage, range_coverage and their mean."""
    numerical, categorical = shared_kinds(real, syn, kinds)
    n_syn = F.count(F.lit(1))
    uniq = syn.distinct().agg(F.count(F.lit(1)).alias("u")).crossJoin(syn.agg(n_syn.alias("n")))
    unique_ratio = uniq.select(F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("u") / F.col("n")).alias("unique_ratio"))
    # categories: distinct non-null string values per side, intersected by an inner join
    cats_r = long_categorical(real, categorical, keep_null=False).distinct()
    cats_s = long_categorical(syn, categorical, keep_null=False).distinct()
    inter = cats_r.join(cats_s, ["col", "v"]).groupBy("col").agg(F.count(F.lit(1)).alias("k"))
    per_col = cats_r.groupBy("col").agg(F.count(F.lit(1)).alias("nr")).join(inter, "col", "left")
    cat_cov = per_col.agg(F.coalesce(F.avg(F.coalesce(F.col("k"), F.lit(0)) / F.col("nr")), F.lit(1.0)).alias("category_coverage"))
    # ranges: covered share of the real span, zero-span columns skipped
    lr = long_numeric(real, numerical).groupBy("col").agg(F.min("v").alias("rlo"), F.max("v").alias("rhi"))
    ls = long_numeric(syn, numerical).groupBy("col").agg(F.min("v").alias("slo"), F.max("v").alias("shi"))
    span = F.col("rhi") - F.col("rlo")
    covered = F.coalesce(F.least(F.col("rhi"), F.col("shi")) - F.greatest(F.col("rlo"), F.col("slo")), F.lit(0.0))
    rng = lr.join(ls, "col", "left").where(span > 0).select(
        F.least(F.greatest(covered / span, F.lit(0.0)), F.lit(1.0)).alias("cov"))
    rng_cov = rng.agg(F.coalesce(F.avg("cov"), F.lit(1.0)).alias("range_coverage"))
    out = unique_ratio.crossJoin(cat_cov).crossJoin(rng_cov)  # three one-row frames
    return out.select(
        r6((F.col("unique_ratio") + F.col("category_coverage") + F.col("range_coverage")) / 3).alias("diversity_score"),
        r6(F.col("unique_ratio")).alias("unique_ratio"), r6(F.col("category_coverage")).alias("category_coverage"),
        r6(F.col("range_coverage")).alias("range_coverage"))


def class_share_comparison(real: DataFrame, syn: DataFrame, target: str) -> DataFrame:
    """outer-aligned class shares, original vs synthetic, missing -> 0; null is the class ``nan``."""
    sh = category_shares(real, syn, [target], keep_null=True)
    return sh.select(F.col("v").alias("class"), r6(F.col("p")).alias("original_share"), r6(F.col("q")).alias("synthetic_share"))


def histogram_comparison(real: DataFrame, syn: DataFrame, kinds=None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """overlaid histograms of the numerical columns: column_name, bin, lower, upper, rows and shares of both sides.

    Equal bins over the joint range of both tables, the last one closed, empty ones
    included; a column with a single value has one bin. Nulls, NaN and infinities are in no bin.
    """
    numerical, _ = shared_kinds(real, syn, kinds)
    values = long_numeric(tagged_union(real, syn, numerical), numerical, extra=["src"]).where(F.abs("v") < float("inf"))
    ranges = values.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(1 - F.col("src")).alias("na"), F.sum("src").alias("nb"))
    ranges = cut_lineage(ranges)  # one row per column, read three times
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                                                     F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
    counts = values.join(F.broadcast(ranges.select("col", "lo", "hi")), "col").groupBy("col", place.alias("bin")).agg(
        F.sum(1 - F.col("src")).alias("a"), F.sum("src").alias("b"))
    every = F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))
    grid = ranges.withColumn("bin", F.explode(every.cast("array<bigint>")))
    a, b = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in "ab")
    return grid.join(counts, ["col", "bin"], "left").select(
        F.col("col").alias("column_name"), "bin", r6(F.col("lo") + F.col("bin") * width).alias("lower"),
        r6(F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), a.alias("original_rows"), b.alias("synthetic_rows"),
        r6(F.coalesce(safe_div(a, F.col("na")), F.lit(0.0))).alias("original_share"),
        r6(F.coalesce(safe_div(b, F.col("nb")), F.lit(0.0))).alias("synthetic_share"))


def correlation_comparison(real: DataFrame, syn: DataFrame, kinds=None) -> DataFrame:
    """both correlation matrices side by side: row_column, column_name, original, synthetic, difference."""
    numerical, _ = shared_kinds(real, syn, kinds)
    if not numerical:
        return real.sparkSession.createDataFrame([], "row_column string, column_name string, original double, synthetic double, difference double")
    original, synthetic = (correlation_matrix(df, numerical).withColumnRenamed("correlation", name)
                           for df, name in ((real, "original"), (syn, "synthetic")))
    return original.join(synthetic, ["row_column", "column_name"]).withColumn("difference", r6(F.col("synthetic") - F.col("original")))
