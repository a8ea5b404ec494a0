"""Synthetic row generators (survey G1-G6, G9-G11).

Every generator is a pure DataFrame plan over ``spark.range(n)``: draws are
seeded md5 uniforms of (seed, draw id), so results do not depend on the
partitioning or on which executor computes them.  Fitted state is O(columns^2)
(moments, quantile grids, a correlation matrix) and lives on the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.exprs import as_category, box_muller, norm_cdf, probit, probit_step, row_key, seeded_uniform
from tabvet.session import cut_lineage, written
from tabvet.operators.pairs import (INTEGER_TYPES, column_kinds_of, distinct_counts, hash_index, is_numeric_type,
                                    join_scores, kinds_from, long_categorical, long_numeric, prefix_sum, rank_within, schema_types)

# Relative noise of the bootstrap and copula grid resolution.
BOOTSTRAP_NOISE = 0.01
COPULA_GRID = 1000
# Buckets of [0, 1) that level intervals and draws are joined on.
LEVEL_BUCKETS = 1024


class GeneratorError(ValueError):
    """A generator cannot produce the requested rows."""


def _condition_mask(df: DataFrame, where: dict | None) -> Column:
    """Rows whose value equals the condition by string form (booleans case-insensitive) or lies in (low, high), None being open."""
    mask = F.lit(True)
    for col, value in (where or {}).items():
        if col not in df.columns:
            raise GeneratorError(f"Condition column '{col}' not found.")
        if isinstance(value, tuple):
            low, high = value
            inside = F.col(col).isNotNull()
            mask = mask & (inside if low is None else inside & (F.col(col) >= F.lit(low))) & (F.lit(True) if high is None else F.col(col) <= F.lit(high))
            continue
        text = str(value).lower() if isinstance(value, bool) else str(value)
        left = F.lower(F.col(col).cast("string")) if isinstance(value, bool) else F.col(col).cast("string")
        if isinstance(value, float) and value.is_integer() and isinstance(schema_types(df)[col], INTEGER_TYPES):
            text = str(int(value))
        mask = mask & (left == F.lit(text))
    return mask


def bootstrap_sample(df: DataFrame, n: int, seed: int = 42, where: dict | None = None,
                     numerical: Sequence[str] | None = None) -> DataFrame:
    """N rows drawn with replacement, numeric columns jittered by N(0, 0.01 sigma).

    Noise scale, clipping range and the numeric column list always come from
    the full table, even when ``where`` restricts the source rows.
    """
    if n <= 0:
        raise GeneratorError("asked for no rows")
    spark = df.sparkSession
    types = schema_types(df)
    if numerical is None:
        numerical, _ = column_kinds_of(df)
    stats = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"sd_{c}") for c in numerical],
                   *[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in numerical],
                   *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in numerical]).first() if numerical else None
    source = df.where(_condition_mask(df, where)) if where else df
    m = source.count()
    if m == 0:
        if where:
            raise GeneratorError(f"no row meets {where!r}")
        raise GeneratorError("nothing to draw from: the table is empty")
    keyed = source.withColumn("_u", seeded_uniform(seed, row_key(source), "bootstrap_index"))
    indexed = hash_index(keyed, "_u").drop("_u")
    draws = spark.range(int(n)).select(
        F.col("id").alias("_draw"),
        F.floor(seeded_uniform(seed, F.col("id"), "draw") * F.lit(m)).cast("bigint").alias("_idx"))
    picked = draws.join(indexed, "_idx")
    out = []
    for c in df.columns:
        col = F.col(c)
        if c in numerical:
            sd, mn, mx = stats[f"sd_{c}"], stats[f"mn_{c}"], stats[f"mx_{c}"]
            v = col.cast("double")
            if sd is not None and sd > 0:
                z = box_muller(seeded_uniform(seed, F.col("_draw"), f"n1:{c}"), seeded_uniform(seed, F.col("_draw"), f"n2:{c}"))
                v = v + z * F.lit(BOOTSTRAP_NOISE * sd)
            if mn is not None and mx is not None:
                v = F.least(F.greatest(v, F.lit(mn)), F.lit(mx))
            if isinstance(types[c], INTEGER_TYPES):
                v = F.rint(v)
            col = v.cast(types[c])
        out.append(col.alias(c))
    return written(picked.select("_draw", *out))  # callers read the sample many times, often a few columns of it


def align_output(syn: DataFrame, like: DataFrame, n_expected: int | None = None, where: dict | None = None) -> DataFrame:
    """Same columns and order as ``like``, numeric columns coerced; condition and count checked."""
    missing = [c for c in like.columns if c not in syn.columns]
    if missing:
        raise GeneratorError(f"Generated output is missing columns {missing}.")
    types = schema_types(like)
    cols = []
    for c in like.columns:
        if is_numeric_type(types[c]) and not isinstance(types[c], T.BooleanType):
            cols.append(F.col(c).cast("string").try_cast(types[c].simpleString()).alias(c))
        else:
            cols.append(F.col(c).cast(types[c]).alias(c))
    out = syn.select(*cols)
    checks = [F.count(F.lit(1)).alias("n")]
    if where:
        checks.append(F.count_if(~_condition_mask(out, where)).alias("bad"))
    row = out.agg(*checks).first()
    if n_expected is not None and row["n"] != n_expected:
        raise GeneratorError(f"Generator returned {row['n']} rows, {n_expected} were requested.")
    if where and row["bad"]:
        raise GeneratorError(f"{row['bad']} generated rows violate the condition {where!r}.")
    return out


def empty_like(df: DataFrame) -> DataFrame:
    """Nothing requested -> an empty table with the same schema."""
    return df.limit(0)


# ---- Gaussian copula (G3-G5) ------------------------------------------------

@dataclass
class CopulaModel:
    columns: list[str]
    types: dict[str, str]
    numerical: list[str]
    categorical: list[str]
    grids: dict[str, list[float]]            # numeric: quantiles at k / (K - 1)
    levels: DataFrame | None                 # written table: col, v, and the interval lo <= u < hi of the level's cumulative share
    null_share: dict[str, float]
    corr: list[list[float]]
    latent: list[str] = field(default_factory=list)


def copula_fit(df: DataFrame, grid: int = COPULA_GRID) -> CopulaModel:
    """Marginals (quantile grids / category intervals) + latent normal correlation.

    Grids come from mergeable quantile sketches with a rank error of at most 1 in 10,000. Levels, as many as there are, stay
    in a table in the shared folder, which joins broadcast only if it is small. Normal scores use mid-rank CDF values from a distributed prefix sum; the
    correlation matrix comes from one aggregate of pair moments.
    """
    from tabvet.operators.fidelity import pearson_pairs

    types = schema_types(df)
    unique = distinct_counts(df)
    numerical, categorical = kinds_from(df, unique)
    probs = [k / (grid - 1) for k in range(grid)]
    grids = {}
    if numerical:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10000).alias(c) for c in numerical]).first()
        grids = {c: [float(x) for x in (row[c] or [])] for c in numerical}
    null_share = {}
    nulls = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    for c in df.columns:
        null_share[c] = float(nulls[c] or 0.0)
    levels = None
    if categorical:
        counts = cut_lineage(long_categorical(df, categorical).groupBy("col", "v").agg(F.count(F.lit(1)).alias("k")))
        totals = counts.groupBy("col").agg(F.sum("k").alias("tot"))
        ends = prefix_sum(counts, ["col"], "v", ["k"]).join(totals, "col")
        levels = written(ends.select("col", "v", ((F.col("cum_k") - F.col("k")) / F.col("tot")).alias("lo"), (F.col("cum_k") / F.col("tot")).alias("hi")))
    # latent normal scores: numeric via mid-rank CDF (one prefix sum for all
    # columns), categorical via the midpoint of the category interval
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in numerical], *[as_category(F.col(c)).alias(c) for c in categorical])
    vc = cut_lineage(long_numeric(wide, numerical).groupBy("col", "v").agg(F.count(F.lit(1)).alias("k")))
    ntot = vc.groupBy("col").agg(F.sum("k").alias("tot"))
    cdf = prefix_sum(vc, ["col"], "v", ["k"]).join(F.broadcast(ntot), "col").select(
        "col", "v", ((F.col("cum_k") - F.col("k") / 2.0) / F.col("tot")).alias("p"))
    latent_cols = [f"z_{c}" for c in numerical + categorical]
    d = len(latent_cols)
    corr = np.eye(d)
    if d >= 2:
        # a value's normal score is taken once, and joined to the rows by value
        scores = join_scores(wide, cdf.select("col", "v", probit(F.col("p")).alias("score")), numerical)
        if categorical:
            mids = levels.select("col", "v", probit((F.col("lo") + F.col("hi")) / 2).alias("score"))
            scores = join_scores(scores, mids, categorical)
        scores = scores.toDF(*latent_cols)
        for r in pearson_pairs(scores, latent_cols).collect():
            i, j = latent_cols.index(r["a"]), latent_cols.index(r["b"])
            corr[i, j] = corr[j, i] = float(r["rho"])
    return CopulaModel(columns=list(df.columns), types={c: types[c].simpleString() for c in df.columns},
                       numerical=numerical, categorical=categorical, grids=grids, levels=levels,
                       null_share=null_share, corr=_nearest_pd(corr).tolist(), latent=numerical + categorical)


def _nearest_pd(c: np.ndarray) -> np.ndarray:
    """Clip eigenvalues so the correlation matrix has a Cholesky factor."""
    if c.size == 0:
        return c
    w, v = np.linalg.eigh((c + c.T) / 2)
    fixed = v @ np.diag(np.clip(w, 1e-6, None)) @ v.T
    s = np.sqrt(np.diag(fixed))
    return fixed / np.outer(s, s)


def _grid_lookup(grid: list[float], u: Column) -> Column:
    """Inverse CDF by linear interpolation in a quantile grid (literal array)."""
    k = len(grid)
    arr = F.lit(np.asarray(grid, dtype=float).tolist())
    pos = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * F.lit(float(k - 1))
    i = F.least(F.floor(pos).cast("int"), F.lit(k - 2))
    lo, hi = F.element_at(arr, i + 1), F.element_at(arr, i + 2)
    return lo + (pos - i) * (hi - lo)


def _with_level(rows: DataFrame, levels: DataFrame, column: str, u: str, name: str) -> DataFrame:
    """``name``: the level of ``column`` whose interval holds ``u``; joined on buckets of [0, 1)."""
    b = F.lit(LEVEL_BUCKETS)
    own = levels.where(F.col("col") == column).select(
        F.col("v").alias(name), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.explode(F.sequence(F.floor(F.col("lo") * b).cast("int"), F.least(F.floor(F.col("hi") * b).cast("int"), b - 1))).alias("_bucket"))
    keyed = rows.withColumn("_at", F.least(F.greatest(F.col(u), F.lit(0.0)), F.lit(1.0 - 2.0**-53)))
    keyed = keyed.withColumn("_in", F.floor(F.col("_at") * b).cast("int"))
    held = (F.col("_in") == F.col("_bucket")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    return keyed.join(own, held, "left").drop("_at", "_in", "_lo", "_hi", "_bucket")


def _level_text(model: CopulaModel, column: str, value) -> str:
    """A condition's value as the levels have it."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and model.types[column] in ("tinyint", "smallint", "int", "bigint"):
        return str(int(value))
    return str(value)


def _inverse_normal(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, 1e-300), 1 - 2.0**-53))


def _latent_range(model: CopulaModel, column: str, value) -> tuple[float, float, float | None, float | None]:
    """A condition as an interval of u, and for a numeric column as an interval of values."""
    if column not in model.columns:
        raise GeneratorError(f"Condition column '{column}' not found.")
    if column in model.categorical:
        if isinstance(value, tuple):
            raise GeneratorError(f"'{column}' is categorical: an interval needs a numeric column.")
        hit = model.levels.where((F.col("col") == column) & (F.col("v") == _level_text(model, column, value))).first()
        if hit is None:
            raise GeneratorError(f"No rows available for condition {column}={value!r}.")
        return hit.lo, hit.hi, None, None
    grid = np.asarray(model.grids.get(column) or [], float)
    if not len(grid):
        raise GeneratorError(f"'{column}' has no values.")
    low, high = value if isinstance(value, tuple) else (value, value)
    low, high = float(grid[0] if low is None else low), float(grid[-1] if high is None else high)
    if model.types[column] in ("tinyint", "smallint", "int", "bigint"):
        low, high = math.ceil(low), math.floor(high)
    low, high = max(low, float(grid[0])), min(high, float(grid[-1]))
    if not low <= high:
        raise GeneratorError(f"No value of '{column}' meets {value!r}; its range is {grid[0]} to {grid[-1]}.")
    places = np.linspace(0, 1, len(grid))

    def share(x: float, side: str) -> float:
        at = np.flatnonzero(grid == x)
        return float(places[at[0] if side == "low" else at[-1]]) if len(at) else float(np.interp(x, grid, places))

    return share(low, "low"), share(high, "high"), low, high


def copula_sample(spark: SparkSession, model: CopulaModel, n: int, seed: int = 42, where: dict | None = None) -> DataFrame:
    """Latent normals -> correlated -> inverse marginals.

    ``where``: a value of a categorical or numeric column, or (low, high) of a numeric one, None being open. The
    conditioned latents come first, each drawn from its normal given those before, truncated to
    the condition's interval (sequential draws as in the GHK simulator); the others follow from their
    normal given these. Every row meets the condition, none is rejected. With one condition the draws
    are exactly those of the conditional copula; with several, the order of the conditions has a small influence.
    """
    cond = dict(where or {})
    ranges = {c: _latent_range(model, c, v) for c, v in cond.items()}
    latent = [*cond, *[c for c in model.latent if c not in cond]]
    d = len(latent)
    order = [model.latent.index(c) for c in latent]
    chol = np.linalg.cholesky(_nearest_pd(np.array(model.corr)[np.ix_(order, order)])) if d else np.zeros((0, 0))
    # Stage the projections (draws -> eps -> z -> u -> values) so every
    # intermediate is a column computed once, never an inlined subtree.
    staged = spark.range(int(n)).select(F.col("id").alias("_draw"))
    staged = staged.select("_draw", *[
        box_muller(seeded_uniform(seed, F.col("_draw"), f"e1:{c}"), seeded_uniform(seed, F.col("_draw"), f"e2:{c}")).alias(f"_e{i}")
        for i, c in enumerate(latent) if c not in cond])
    edge = float(np.finfo(float).tiny)
    for i, c in enumerate(cond):
        low, high, _, _ = ranges[c]
        mean = sum((F.lit(float(chol[i, k])) * F.col(f"_e{k}") for k in range(i)), F.lit(0.0))
        scale = F.lit(float(chol[i, i]))
        # every step is a column of its own: the normal functions use their argument many times
        staged = staged.withColumn("_mean", mean)
        staged = staged.withColumn("_a", (F.lit(_inverse_normal(low)) - F.col("_mean")) / scale).withColumn("_b", (F.lit(_inverse_normal(high)) - F.col("_mean")) / scale)
        staged = staged.withColumn("_from", norm_cdf(F.col("_a"))).withColumn("_to", norm_cdf(F.col("_b")))
        staged = staged.withColumn("_p", F.greatest(F.col("_from") + seeded_uniform(seed, F.col("_draw"), f"c:{c}") * (F.col("_to") - F.col("_from")), F.lit(edge)))
        staged = staged.withColumn(f"_e{i}", probit(F.col("_p"))).drop("_mean", "_a", "_b", "_from", "_to", "_p")
    staged = staged.select("_draw", *[
        sum((F.lit(float(chol[i, k])) * F.col(f"_e{k}") for k in range(i + 1)), F.lit(0.0)).alias(f"_z{i}") for i in range(d)])
    staged = staged.select("_draw", *[norm_cdf(F.col(f"_z{i}")).alias(f"_u{i}") for i in range(d)])
    # written before the joins: the optimiser would carry the normal functions into every join condition
    staged = cut_lineage(staged) if any(c not in cond for c in model.categorical) else staged
    for i, c in enumerate(latent):
        if c in model.categorical and c not in cond:
            staged = _with_level(staged, model.levels, c, f"_u{i}", f"_v{i}")
    cols = []
    for c in model.columns:
        i = latent.index(c) if c in latent else None
        if c in model.numerical:
            val = _grid_lookup(model.grids[c], F.col(f"_u{i}")) if model.grids.get(c) else F.lit(None)
            if model.null_share.get(c, 0.0) > 0 and c not in cond:
                miss = seeded_uniform(seed, F.col("_draw"), f"null:{c}") < F.lit(model.null_share[c])
                val = F.when(miss, F.lit(None)).otherwise(val)
            if model.types[c] in ("tinyint", "smallint", "int", "bigint"):
                val = F.rint(val)
            if c in cond:
                val = F.least(F.greatest(val, F.lit(float(ranges[c][2]))), F.lit(float(ranges[c][3])))
        else:
            val = F.lit(_level_text(model, c, cond[c])) if c in cond else F.col(f"_v{i}")
            val = F.when(val == F.lit("nan"), F.lit(None)).otherwise(val)
        cols.append(val.cast(model.types[c]).alias(c))
    return staged.select(*cols)


# ---- mixed-table codec (G9, G10) --------------------------------------------

@dataclass
class CodecState:
    columns: list[str]
    types: dict[str, str]
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    grids: dict[str, list[float]]
    flagged: list[str]              # numeric columns with missing values: these carry a flag
    vocabulary: DataFrame           # (col, v, code), code = 0.. in value order, null last
    sizes: dict[str, int]           # categories per column


def _missing(df: DataFrame, c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x)


def _vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, v, code): the distinct values of each column, numbered on the executors."""
    if not columns:
        return df.sparkSession.createDataFrame([], "col string, v string, code bigint")
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    values = wide.unpivot([], list(columns), "col", "v").distinct().withColumn("_null", F.col("v").isNull())
    return cut_lineage(rank_within(values, ["col"], ["_null", "v"], "code").select("col", "v", "code"))


def _grid_position(grid: list[float], x: Column, bucket: Column) -> Column:
    """Place of x on the grid's index axis: linear between neighbouring knots, the middle of
    its run for a value that holds several knots, the ends beyond them."""
    knots = sorted(set(grid))
    first = {v: i for i, v in reversed(list(enumerate(grid)))}
    last = {v: i for i, v in enumerate(grid)}
    m = len(knots)
    values = F.lit(knots)
    middles = F.lit([(first[v] + last[v]) / 2.0 for v in knots])
    lasts = F.lit([float(last[v]) for v in knots])
    at = F.least(F.greatest(bucket, F.lit(1)), F.lit(m))
    lo, hi = F.element_at(values, at), F.element_at(values, F.least(at + 1, F.lit(m)))
    middle = F.element_at(middles, at)
    return F.when((x <= lo) | (bucket >= m), middle).otherwise(F.element_at(lasts, at) + (x - lo) / (hi - lo))


def mixed_encode(df: DataFrame, quantiles: int = COPULA_GRID) -> tuple[DataFrame, CodecState]:
    """Numeric columns (> 12 distinct) as normal scores, all others as vocabulary codes.

    Missing numbers (null, NaN) take the median, and columns that have some get a
    ``<column>__missing`` flag.  A score is the probit of the place between two knots of a
    quantile grid (a mergeable sketch with the exact ends), found by binary search, so the
    map is strictly monotone and decoding gives the value back to double precision.  The
    vocabulary (null is a value) stays a table that is joined, whatever its size.
    """
    types = schema_types(df)
    numeric, _ = column_kinds_of(df)
    numeric = [c for c in numeric if not isinstance(types[c], T.BooleanType)]
    categorical = [c for c in df.columns if c not in numeric]
    grids, medians, flagged = {}, {}, []
    if numeric:
        present = {c: F.when(~_missing(df, c), F.col(c).cast("double")) for c in numeric}
        k = max(2, min(quantiles, df.count()))
        probs = [i / (k - 1) for i in range(k)]
        row = df.agg(*[F.percentile_approx(x, probs + [0.5], 10000).alias(f"g_{c}") for c, x in present.items()],
                     *[F.min(x).alias(f"lo_{c}") for c, x in present.items()],
                     *[F.max(x).alias(f"hi_{c}") for c, x in present.items()],
                     *[F.count_if(_missing(df, c)).alias(f"n_{c}") for c in numeric]).first()
        for c in numeric:
            *knots, medians[c] = (float(x) for x in row[f"g_{c}"])
            grids[c] = [float(row[f"lo_{c}"]), *knots[1:-1], float(row[f"hi_{c}"])]
        flagged = [c for c in numeric if row[f"n_{c}"]]
    vocabulary = _vocabulary(df, categorical)
    sizes = {r["col"]: int(r["count"]) for r in vocabulary.groupBy("col").count().collect()}
    state = CodecState(list(df.columns), {c: types[c].simpleString() for c in df.columns}, numeric, categorical,
                       medians, grids, flagged, vocabulary, sizes)
    # staged projections (x -> bucket -> u -> z), so that no stage is inlined many times
    kept = [F.col(f"_m{i}") for i, c in enumerate(numeric) if c in flagged] + [F.col(f"_c{j}") for j in range(len(categorical))]
    work = df.select(
        *[F.when(_missing(df, c), F.lit(medians[c])).otherwise(F.col(c).cast("double")).alias(f"_x{i}") for i, c in enumerate(numeric)],
        *[_missing(df, c).cast("double").alias(f"_m{i}") for i, c in enumerate(numeric) if c in flagged],
        *[F.col(c).cast("string").alias(f"_c{j}") for j, c in enumerate(categorical)])
    if numeric:
        ids = range(len(numeric))
        work = Bucketizer(inputCols=[f"_x{i}" for i in ids], outputCols=[f"_b{i}" for i in ids],
                          splitsArray=[[-math.inf, *sorted(set(grids[c])), math.inf] for c in numeric]).transform(work)
        work = work.select(*[((_grid_position(grids[c], F.col(f"_x{i}"), F.col(f"_b{i}").cast("int")) + F.lit(0.5))
                              / F.lit(float(len(grids[c])))).alias(f"_u{i}") for i, c in enumerate(numeric)], *kept)
        work = work.select("*", *[probit(F.col(f"_u{i}")).alias(f"_s{i}") for i in ids])
        work = work.select(*[probit_step(F.col(f"_s{i}"), F.col(f"_u{i}")).alias(f"_z{i}") for i in ids], *kept)
    for j, c in enumerate(categorical):
        codes = vocabulary.where(F.col("col") == c).select(F.col("v").alias(f"_v{j}"), F.col("code").alias(f"_k{j}"))
        work = work.join(codes, F.col(f"_c{j}").eqNullSafe(F.col(f"_v{j}")), "left").drop(f"_c{j}", f"_v{j}")
    out = []
    for i, c in enumerate(numeric):
        out += [F.col(f"_z{i}").alias(c)] + ([F.col(f"_m{i}").alias(f"{c}__missing")] if c in flagged else [])
    return work.select(*out, *[F.col(f"_k{j}").alias(c) for j, c in enumerate(categorical)]), state


def mixed_decode(encoded: DataFrame, state: CodecState) -> DataFrame:
    """Inverse of mixed_encode; scores beyond the grid and codes beyond the vocabulary take its ends."""
    numeric = {}
    for c in state.numeric:
        k = len(state.grids[c])
        place = (F.col(f"_u_{c}") * F.lit(float(k)) - F.lit(0.5)) / F.lit(float(k - 1))
        v = _grid_lookup(state.grids[c], place)
        v = F.rint(v) if state.types[c] in ("tinyint", "smallint", "int", "bigint") else v
        numeric[c] = F.when(F.col(f"{c}__missing") >= 0.5, F.lit(None)).otherwise(v) if c in state.flagged else v
    work = encoded.select("*", *[norm_cdf(F.col(c)).alias(f"_u_{c}") for c in state.numeric])
    for j, c in enumerate(state.categorical):
        values = state.vocabulary.where(F.col("col") == c).select(F.col("v").alias(f"_v{j}"), F.col("code").alias(f"_k{j}"))
        code = F.least(F.greatest(F.col(c), F.lit(0)), F.lit(state.sizes.get(c, 1) - 1))
        work = work.join(values, code == F.col(f"_k{j}"), "left")
    return work.select(*[(numeric[c] if c in numeric else F.col(f"_v{state.categorical.index(c)}"))
                         .cast(state.types[c]).alias(c) for c in state.columns])


# ---- generator registry (G11) -----------------------------------------------

_NAME = re.compile(r"^[a-z][a-z0-9_]*$")


@dataclass
class GeneratorSpec:
    name: str
    fit: Callable[[DataFrame], object]
    sample: Callable[..., DataFrame]
    conditional: bool = False
    available: bool = True


_REGISTRY: dict[str, GeneratorSpec] = {}


def register_generator(name: str, fit: Callable[[DataFrame], object], sample: Callable[..., DataFrame],
                       conditional: bool = False, available: bool = True) -> GeneratorSpec:
    """Add a generator; names are [a-z][a-z0-9_]* and never overwritten."""
    if not _NAME.match(name):
        raise GeneratorError(f"Invalid generator name {name!r}.")
    if name in _REGISTRY:
        raise GeneratorError(f"Generator {name!r} is already registered.")
    spec = GeneratorSpec(name, fit, sample, conditional, available)
    _REGISTRY[name] = spec
    return spec


def get_generator(name: str) -> GeneratorSpec:
    if name not in _REGISTRY:
        raise GeneratorError(f"Unknown generator {name!r}.")
    spec = _REGISTRY[name]
    if not spec.available:
        raise GeneratorError(f"Generator {name!r} is not available.")
    return spec


def generate(name: str, df: DataFrame, n: int, seed: int = 42, where: dict | None = None) -> DataFrame:
    """Fit + sample + align (G6) through the registry; failures raise under the generator's name."""
    from tabvet.operators.profile import validate_generator_input

    spec = get_generator(name)
    if where and not spec.conditional:
        raise GeneratorError(f"Generator {name!r} does not support conditional sampling.")
    if n <= 0:
        return empty_like(df)
    validate_generator_input(df)
    try:
        params = spec.fit(df)
        out = spec.sample(df.sparkSession, params, n, seed, where)
    except GeneratorError:
        raise
    except Exception as exc:  # noqa: BLE001 - reported under the generator's name
        raise GeneratorError(f"Generator {name!r} failed: {exc}") from exc
    return align_output(out, df, n, where)


def _builtin() -> None:
    if "bootstrap" not in _REGISTRY:
        register_generator("bootstrap", lambda df: df,
                           lambda spark, df, n, seed, where: bootstrap_sample(df, n, seed, where).drop("_draw"),
                           conditional=True)
    if "gaussian_copula" not in _REGISTRY:
        register_generator("gaussian_copula", copula_fit,
                           lambda spark, model, n, seed, where: copula_sample(spark, model, n, seed, where),
                           conditional=True)


_builtin()
