"""Memorisation and nearest-neighbour privacy indicators (survey V1-V6).

Exact copies: distinct synthetic rows (with multiplicities) are semi-joined
against distinct real rows on null-safe equality of every column, so a hot
duplicate group is collapsed before any shuffle.

Nearest neighbours: the reference set is a seeded sample with a hard size
bound (``cap``).  It is collected once (at most ``cap`` rows) and shipped as a
literal array; every probed row computes its minimum distance with array
lambdas, so no pair of rows is ever materialised by a join.

``sample_syn=None, sample_real=None`` of the near-match rate and
``distance_privacy_all`` search all rows of both tables (``neighbours``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.exprs import r6, row_key, seeded_uniform
from tabvet.operators.neighbours import Gower, MeanDifference, Search, as_points
from tabvet.operators.pairs import exact_quantiles, is_numeric_type, schema_types, shared_kinds
from tabvet.session import written

# Thresholds and default sample sizes.
NEAR_THRESHOLD = 0.05
DEFAULT_SYN_SAMPLE = 80
DEFAULT_REAL_SAMPLE = 200
DISTANCE_CAP = 128
DISTANCE_NEAR = 0.01
NO_NEIGHBOUR = 1e9


def exact_match_rate(real: DataFrame, syn: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """V1: (exact_duplicate_rate, matched_rows, synthetic_rows)."""
    cols = list(columns) if columns is not None else [c for c in syn.columns if c in real.columns]
    syn_groups = syn.groupBy(*cols).agg(F.count(F.lit(1)).alias("_m"))
    real_rows = real.select(*cols).distinct()
    r = real_rows.select(*[F.col(c).alias(f"_r_{c}") for c in cols])
    cond = [syn_groups[c].eqNullSafe(r[f"_r_{c}"]) for c in cols]
    matched = syn_groups.join(r, cond, "left_semi").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("matched"))
    total = syn.agg(F.count(F.lit(1)).alias("n"))
    return matched.crossJoin(total).select(  # two one-row aggregates
        r6(F.when(F.col("n") > 0, F.col("matched") / F.col("n")).otherwise(F.lit(0.0))).alias("exact_duplicate_rate"),
        F.col("matched").cast("bigint").alias("matched_rows"), F.col("n").cast("bigint").alias("synthetic_rows"))


def seeded_sample(df: DataFrame, n: int | None, seed: int = 42, tag: str = "sample") -> DataFrame:
    """First n rows by a seeded content hash (ties: column values); all rows if n is None."""
    if n is None:
        return df
    keyed = df.withColumn("_u", seeded_uniform(seed, row_key(df), tag))
    return keyed.orderBy("_u", *df.columns).limit(int(n)).drop("_u")


def _bounded_rows(df: DataFrame, cap: int) -> list:
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"reference sample exceeds its bound of {cap} rows")
    return rows


def _literal_array(rows: list, fields: list[tuple[str, T.DataType]]) -> Column:
    structs = []
    for r in rows:
        structs.append(F.struct(*[F.lit(r[name]).cast(dt).alias(f"f{i}") for i, (name, dt) in enumerate(fields)]))
    if not structs:
        return F.array().cast(T.ArrayType(T.StructType([T.StructField(f"f{i}", dt) for i, (_, dt) in enumerate(fields)])))
    return F.array(*structs)


def _gower_min(ref: Column, numerical: Sequence[str], categorical: Sequence[str], spans: dict[str, float],
               fields: list[str]) -> Column:
    """min over the reference array of the mean Gower distance (reference V2 rule)."""
    pos = {c: i for i, c in enumerate(fields)}

    def dist(e):
        total = F.lit(0.0)
        parts = F.lit(0)
        for c in numerical:
            s, o = F.col(c).cast("double"), e[f"f{pos[c]}"]
            ok = s.isNotNull() & o.isNotNull() & ~F.isnan(s) & ~F.isnan(o)
            total = total + F.when(ok, F.abs(s - o) / F.lit(spans[c])).otherwise(F.lit(0.0))
            parts = parts + F.when(ok, F.lit(1)).otherwise(F.lit(0))
        for c in categorical:
            s, o = F.coalesce(F.col(c).cast("string"), F.lit("None")), F.coalesce(e[f"f{pos[c]}"], F.lit("None"))
            total = total + F.when(s == o, F.lit(0.0)).otherwise(F.lit(1.0))
            parts = parts + F.lit(1)
        return F.when(parts > 0, total / parts).otherwise(F.lit(NO_NEIGHBOUR))

    return F.coalesce(F.array_min(F.transform(ref, dist)), F.lit(NO_NEIGHBOUR))


def _close_rows(real: DataFrame, probe: DataFrame, numerical: Sequence[str], categorical: Sequence[str],
                spans: dict[str, float], threshold: float) -> DataFrame:
    """(close_rows, probed_rows): every probe row against every real row that can be close to it (survey 7.6).

    The neighbour search compares a probe with its own cell first; where nothing there is close it visits the
    cells that can hold something below the threshold. Any number of columns; hot cells are cut into packs.
    """
    space = Gower(np.array([spans[c] for c in numerical], float), NO_NEIGHBOUR)
    search = Search(as_points(real, list(numerical), list(categorical)), space, len(numerical), len(categorical))

    def counts(x, c, m, s, found):
        close = np.zeros(len(x), bool)
        close[found[0][found[1] < threshold]] = True
        return pa.RecordBatch.from_arrays([pa.array([int(m[close].sum())], pa.int64()), pa.array([int(m.sum())], pa.int64())], names=["close", "probed"])

    found = search.nearest(as_points(probe, list(numerical), list(categorical)), within=threshold, one_is_enough=True, fold=counts, schema="close bigint, probed bigint")
    return found.agg(F.coalesce(F.sum("close"), F.lit(0)).alias("close_rows"), F.coalesce(F.sum("probed"), F.lit(0)).alias("probed_rows"))


def near_match_rate(real: DataFrame, syn: DataFrame, kinds=None, sample_syn: int | None = DEFAULT_SYN_SAMPLE,
                    sample_real: int | None = DEFAULT_REAL_SAMPLE, threshold: float = NEAR_THRESHOLD, seed: int = 42) -> DataFrame:
    """V2: share of (sampled) synthetic rows whose nearest (sampled) real row is closer than 0.05.

    Spans come from the full real table.  ``sample_syn=None`` probes every
    synthetic row against the bounded real sample; ``sample_real=None`` searches
    every real row instead of a sample.
    """
    numerical, categorical = shared_kinds(real, syn, kinds)
    fields = numerical + categorical
    spark = real.sparkSession
    if not fields:
        return spark.createDataFrame([(0.0, 0, 0)], "high_similarity_rate double, close_rows bigint, probed_rows bigint")
    # one aggregate gives the real row count and the spans of the full real table
    stats = real.agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in numerical],
                     *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in numerical]).first()
    n_probe = syn.count() if sample_syn is None else min(sample_syn, syn.limit(sample_syn).count(), int(stats["_n"]))
    spans = {}
    for c in numerical:
        mn, mx = stats[f"mn_{c}"], stats[f"mx_{c}"]
        span = (mx - mn) if mn is not None else 1.0
        spans[c] = span if span else 1.0
    probe = syn.select(*fields) if sample_syn is None else seeded_sample(syn.select(*fields), n_probe, seed, "near_syn")
    if sample_real is None:
        found = _close_rows(real, probe, numerical, categorical, spans, threshold)
        return found.select(r6(F.when(F.col("probed_rows") > 0, F.col("close_rows") / F.col("probed_rows")).otherwise(F.lit(0.0)))
                            .alias("high_similarity_rate"),
                            F.col("close_rows").cast("bigint").alias("close_rows"), F.col("probed_rows").cast("bigint").alias("probed_rows"))
    n_real = min(sample_real, int(stats["_n"]))
    ref_df = seeded_sample(real.select(*[F.col(c).cast("double").alias(c) for c in numerical],
                                       *[F.col(c).cast("string").alias(c) for c in categorical]),
                           min(sample_real, n_real), seed, "near_real")
    ref_rows = _bounded_rows(ref_df, sample_real)
    ref = _literal_array(ref_rows, [(c, T.DoubleType()) for c in numerical] + [(c, T.StringType()) for c in categorical])
    best = probe.select(_gower_min(ref, numerical, categorical, spans, fields).alias("best"))
    return best.agg(
        r6(F.when(F.count(F.lit(1)) > 0, F.avg((F.col("best") < threshold).cast("double"))).otherwise(F.lit(0.0)))
        .alias("high_similarity_rate"),
        F.count_if(F.col("best") < threshold).cast("bigint").alias("close_rows"),
        F.count(F.lit(1)).cast("bigint").alias("probed_rows"))


def risk_level(indicator: Column) -> Column:
    return F.when(indicator >= 0.20, "HIGH").when(indicator >= 0.08, "MEDIUM").otherwise("LOW")


def privacy_score(real: DataFrame, syn: DataFrame, kinds=None, sample_syn: int | None = DEFAULT_SYN_SAMPLE,
                  sample_real: int | None = DEFAULT_REAL_SAMPLE, threshold: float = NEAR_THRESHOLD, seed: int = 42) -> DataFrame:
    """V3: privacy_score = clip(1 - 0.7 dup - 0.3 near), membership indicator, risk level."""
    dup = exact_match_rate(real, syn).select("exact_duplicate_rate")
    near = near_match_rate(real, syn, kinds, sample_syn, sample_real, threshold, seed).select("high_similarity_rate")
    both = dup.crossJoin(near)  # two one-row frames
    ind = F.col("exact_duplicate_rate") + F.lit(0.5) * F.col("high_similarity_rate")
    return both.select(
        r6(F.least(F.greatest(F.lit(1.0) - F.lit(0.7) * F.col("exact_duplicate_rate")
                              - F.lit(0.3) * F.col("high_similarity_rate"), F.lit(0.0)), F.lit(1.0))).alias("privacy_score"),
        "exact_duplicate_rate", "high_similarity_rate", r6(ind).alias("membership_risk_indicator"),
        risk_level(ind).alias("privacy_risk_level"))


def _scaled_min(ref: Column, columns: Sequence[str], numerical: set[str], scales: dict[str, float]) -> Column:
    """min over the reference array of the V4 mean per-column distance."""
    k = len(columns)

    def dist(e):
        total = F.lit(0.0)
        for i, c in enumerate(columns):
            o = e[f"f{i}"]
            if c in numerical:
                s = F.col(c).cast("double")
                s_null = s.isNull() | F.isnan(s)
                o_null = o.isNull() | F.isnan(o)
                part = F.when(s_null & o_null, F.lit(0.0)).when(s_null | o_null, F.lit(1.0)).otherwise(
                    F.abs(s - o) / F.lit(scales[c]))
            else:
                s = F.coalesce(F.col(c).cast("string"), F.lit("None"))
                part = F.when(s == F.coalesce(o, F.lit("None")), F.lit(0.0)).otherwise(F.lit(1.0))
            total = total + part / F.lit(float(k))
        return total

    return F.array_min(F.transform(ref, dist))


def _scales(train: DataFrame, numerical: Sequence[str]) -> dict[str, float]:
    """Population std of each numeric column of the whole training table; 1 where it is nothing."""
    if not numerical:
        return {}
    stds = train.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in numerical]).first()
    return {c: float(stds[c]) if stds[c] is not None and math.isfinite(stds[c]) and stds[c] > 1e-8 else 1.0 for c in numerical}


def attack_report(exact: DataFrame, to_train: DataFrame, to_holdout: DataFrame, members: DataFrame, nonmembers: DataFrame) -> DataFrame:
    """V4-V6 from nearest distances over whole tables, frames of (d, m): m rows have the distance d.

    near_training_match_rate (d < 0.01), exact medians, and the AUC of an attack that takes rows close to synthetic ones for members.
    ``exact`` is a one-row frame and comes first. Rates and medians of no rows are null.
    """
    from tabvet.operators.evaluation import roc_auc

    both = to_train.select(F.lit("train").alias("side"), "d", "m").unionByName(to_holdout.select(F.lit("holdout").alias("side"), "d", "m"))
    medians = exact_quantiles(both, ["side"], "d", [0.5], weight="m")
    medians = medians.agg(*[r6(F.max(F.when(F.col("side") == t, F.col("q")))).alias(f"median_distance_to_{t}") for t in ("train", "holdout")])
    near = to_train.agg(r6(F.try_divide(F.sum(F.when(F.col("d") < DISTANCE_NEAR, F.col("m")).otherwise(0)), F.sum("m"))).alias("near_training_match_rate"))
    scored = members.select(F.lit(1).alias("label"), (-F.col("d")).alias("score"), "m").unionByName(
        nonmembers.select(F.lit(0).alias("label"), (-F.col("d")).alias("score"), "m"))
    auc = roc_auc(scored, "label", "score", weight="m").agg(F.max("auc").alias("distance_attack_auc"))
    counts = scored.agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("m"))), F.lit(0)).cast("bigint").alias(n) for k, n in ((1, "train_rows"), (0, "holdout_rows"))])
    return exact.crossJoin(near).crossJoin(medians).crossJoin(auc).crossJoin(counts)  # one-row frames


def nearest_distances(x, c, m, s, found) -> pa.RecordBatch:
    """(d, m): the distance of the nearest row of each probe that has one."""
    who, at = np.unique(found[0], return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(found[1][at], pa.float64()), pa.array(m[who], pa.int64())], names=["d", "m"])


def distance_privacy_all(train: DataFrame, holdout: DataFrame, syn: DataFrame, numerical: Sequence[str] | None = None) -> DataFrame:
    """V4 + V6 over all rows of the three tables: every row finds its exact nearest neighbour, none is sampled.

    The distance is that of ``distance_privacy``: the mean over the columns of |a - b| / std (nulls: both 0, one 1) and
    of 0 or 1 for categories.
    """
    cols = list(train.columns)
    types = schema_types(train)
    num = list(numerical) if numerical is not None else [c for c in cols if is_numeric_type(types[c])]
    cat = [c for c in cols if c not in num]
    scales = _scales(train, num)
    space = MeanDifference(np.array([scales[c] for c in num], float), len(cols))

    def distances(search: Search, probe: DataFrame) -> DataFrame:
        found = search.nearest(probe, fold=nearest_distances, schema="d double, m bigint")
        return written(found.groupBy("d").agg(F.sum("m").alias("m")))

    # every table is reduced to its points once; two at a time, so that the driver holds few trees and samples at once
    with ThreadPoolExecutor(2) as side_by_side:
        points = list(side_by_side.map(lambda t: written(as_points(t, num, cat)), (train, holdout, syn)))
        searches = list(side_by_side.map(lambda p: Search(p, space, len(num), len(cat)), points))
        found = list(side_by_side.map(lambda at: distances(searches[at[0]], points[at[1]]), ((0, 2), (1, 2), (2, 0), (2, 1))))
    exact = exact_match_rate(train, syn, cols).select(F.col("exact_duplicate_rate").alias("exact_training_match_rate"))
    return attack_report(exact, *found)


def distance_privacy(train: DataFrame, holdout: DataFrame, syn: DataFrame, cap: int = DISTANCE_CAP, seed: int = 42,
                     numerical: Sequence[str] | None = None) -> DataFrame:
    """V4 + V6: exact training-match rate, near (< 0.01) rate, median distances, attack AUC.

    Samples of at most ``cap`` rows from each table; numeric distances are
    scaled by the population std of the full training table.
    """
    from tabvet.operators.evaluation import roc_auc

    cols = list(train.columns)
    types = schema_types(train)
    num = set(numerical) if numerical is not None else {c for c in cols if is_numeric_type(types[c])}
    scales = _scales(train, [c for c in cols if c in num])
    typed = [F.col(c).cast("double").alias(c) if c in num else F.col(c).cast("string").alias(c) for c in cols]
    fields = [(c, T.DoubleType() if c in num else T.StringType()) for c in cols]

    def sample(df, tag):
        return seeded_sample(df.select(*cols).select(*typed), cap, seed, tag)

    spark = train.sparkSession
    rows_real = _bounded_rows(sample(train, "dp_train"), cap)
    rows_held = _bounded_rows(sample(holdout, "dp_holdout"), cap)
    rows_gen = _bounded_rows(sample(syn, "dp_syn"), cap)
    arr_real, arr_held, arr_gen = (_literal_array(r, fields) for r in (rows_real, rows_held, rows_gen))
    # the probe frames are the collected samples themselves (at most ``cap`` rows each),
    # so no full scan and top-k is repeated for every use below
    schema = T.StructType([T.StructField(c, dt) for c, dt in fields])
    real_s, held_s, gen_s = (spark.createDataFrame(r, schema) for r in (rows_real, rows_held, rows_gen))
    to_train = gen_s.select(_scaled_min(arr_real, cols, num, scales).alias("d"))
    to_hold = gen_s.select(_scaled_min(arr_held, cols, num, scales).alias("d"))
    members = real_s.select(F.lit(1).alias("label"), (-_scaled_min(arr_gen, cols, num, scales)).alias("score"))
    nonmembers = held_s.select(F.lit(0).alias("label"), (-_scaled_min(arr_gen, cols, num, scales)).alias("score"))
    auc = roc_auc(members.unionByName(nonmembers), "label", "score").select(F.col("auc").alias("distance_attack_auc"))
    exact = exact_match_rate(train, syn, cols).select(F.col("exact_duplicate_rate").alias("exact_training_match_rate"))
    near = to_train.agg(r6(F.avg((F.col("d") < DISTANCE_NEAR).cast("double"))).alias("near_training_match_rate"),
                        r6(F.median("d")).alias("median_distance_to_train"))
    med_h = to_hold.agg(r6(F.median("d")).alias("median_distance_to_holdout"))
    counts = real_s.agg(F.count(F.lit(1)).cast("bigint").alias("train_sample_count")).crossJoin(
        held_s.agg(F.count(F.lit(1)).cast("bigint").alias("holdout_sample_count")))
    out = exact.crossJoin(near).crossJoin(med_h).crossJoin(auc).crossJoin(counts)  # one-row frames
    return out.withColumn("sample_cap", F.lit(cap).cast("bigint"))
