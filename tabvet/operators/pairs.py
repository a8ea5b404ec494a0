"""Shared mechanisms: column kinds, long form, distributed prefix sums.

Prefix sums, ranks, lags and forward fills never use a window without
``partitionBy``.  A size check first measures the largest group: groups that
fit one task (<= SINGLE_TASK_ROWS) use a plain per-group window.  Larger ones
are range-partitioned on (group, order) so each task holds a contiguous slice;
a per-slice total table gives offsets and a window local to each slice
finishes the job.  The sliced frame is checkpointed so both consumers agree
on the slice ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.exprs import as_category
from tabvet.session import cut_lineage, written

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType, T.BooleanType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Fixed value: the distinct-count limit between categorical and numerical.
KIND_DISTINCT_LIMIT = 12


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def schema_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def check_flat(df: DataFrame) -> None:
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"nested column {f.name!r} ({f.dataType.simpleString()}) is not supported")


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType,
                          T.TimestampType, T.TimestampNTZType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def _as_family(c: str, dtype: T.DataType, family: str) -> Column:
    col = F.col(c)
    if family == "bigint":
        if isinstance(dtype, T.DateType):
            return F.unix_date(col).cast("bigint")
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(col.cast("timestamp"))
        return col.cast("bigint")
    if family == "double":
        return F.when(col == 0, F.lit(0.0)).otherwise(col.cast("double"))  # -0.0 and 0.0 count once
    return col.cast("string")


def distinct_frame(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col, unique_count): distinct non-null values per column, lazily.

    Columns are stacked per type family (integers/booleans/times as bigint,
    floats as double, the rest as string) and grouped on (col, value): one
    map-side-combined group-by per family instead of one count-distinct per
    column (which would expand every row once per column).
    """
    cols = list(columns) if columns is not None else df.columns
    types = schema_types(df)
    out = None
    for family in ("bigint", "double", "string"):
        fam = [c for c in cols if _family(types[c]) == family]
        if not fam:
            continue
        arr = F.array(*[F.struct(F.lit(c).alias("col"), _as_family(c, types[c], family).alias("v")) for c in fam])
        long = df.select(F.explode(arr).alias("x")).select("x.col", "x.v").where(F.col("v").isNotNull())
        counts = long.groupBy("col", "v").agg(F.count(F.lit(1)).alias("k")).groupBy("col").agg(
            F.count(F.lit(1)).cast("bigint").alias("unique_count"))
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        return df.sparkSession.createDataFrame([], "col string, unique_count bigint")
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column (exact by default), one job."""
    cols = list(columns) if columns is not None else df.columns
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(F.col(c), 0.01).alias(f"_d{i}") for i, c in enumerate(cols)]).first()
        return {c: int(row[f"_d{i}"]) for i, c in enumerate(cols)}
    got = {r["col"]: int(r["unique_count"]) for r in distinct_frame(df, cols).collect()}
    return {c: got.get(c, 0) for c in cols}


# Columns whose sketch estimate exceeds this are certainly above the kind limit
# (the sketch's relative error is about 5 %), so only small ones are counted exactly.
EXACT_BELOW = 1000
SKETCH_RSD = 0.05


def kind_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Distinct counts good enough for the 12-value kind rule, cheaply at scale.

    One aggregate of small HyperLogLog sketches (512 registers, merged map-side,
    no value shuffle);
    columns estimated at <= 1000 values are then counted exactly with the
    long-form group-by.  Large columns keep their estimate: it can only be
    used to say "more than 12".
    """
    cols = list(columns) if columns is not None else df.columns
    if not cols:
        return {}
    row = df.agg(*[F.approx_count_distinct(F.col(c), SKETCH_RSD).alias(f"_d{i}") for i, c in enumerate(cols)]).first()
    approx = {c: int(row[f"_d{i}"]) for i, c in enumerate(cols)}
    small = [c for c in cols if approx[c] <= EXACT_BELOW]
    exact = distinct_counts(df, small) if small else {}
    return {c: exact.get(c, approx[c]) for c in cols}


def kinds_from(df: DataFrame, unique: dict[str, int]) -> tuple[list[str], list[str]]:
    """numerical <=> numeric dtype (booleans included) and > 12 distinct."""
    types = schema_types(df)
    numerical = [c for c in df.columns if c in unique and is_numeric_type(types[c]) and unique[c] > KIND_DISTINCT_LIMIT]
    categorical = [c for c in df.columns if c in unique and c not in numerical]
    return numerical, categorical


def column_kinds_of(df: DataFrame) -> tuple[list[str], list[str]]:
    check_flat(df)
    return kinds_from(df, kind_counts(df))


def shared_kinds(real: DataFrame, syn: DataFrame, kinds=None) -> tuple[list[str], list[str]]:
    """Kinds from the real table, restricted to columns present in both."""
    numerical, categorical = kinds if kinds is not None else column_kinds_of(real)
    return ([c for c in numerical if c in syn.columns], [c for c in categorical if c in syn.columns])


def long_numeric(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., col, v DOUBLE) with nulls and NaN dropped."""
    if not columns:
        return df.sparkSession.createDataFrame([], T.StructType(
            [df.schema[e] for e in extra] + [T.StructField("col", T.StringType()), T.StructField("v", T.DoubleType())]))
    wide = df.select(*extra, *[F.col(c).cast("double").alias(c) for c in columns])
    out = wide.unpivot(list(extra), list(columns), "col", "v")
    return out.where(F.col("v").isNotNull() & ~F.isnan("v"))


def long_categorical(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = (), keep_null: bool = True) -> DataFrame:
    """(extra..., col, v STRING); null becomes the category 'nan' unless dropped."""
    if not columns:
        return df.sparkSession.createDataFrame([], T.StructType(
            [df.schema[e] for e in extra] + [T.StructField("col", T.StringType()), T.StructField("v", T.StringType())]))
    if keep_null:
        wide = df.select(*extra, *[as_category(F.col(c)).alias(c) for c in columns])
    else:
        wide = df.select(*extra, *[F.col(c).cast("string").alias(c) for c in columns])
    out = wide.unpivot(list(extra), list(columns), "col", "v")
    return out if keep_null else out.where(F.col("v").isNotNull())


def tagged_union(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """real and syn stacked with a ``src`` tag (0 = real, 1 = synthetic)."""
    cols = list(columns)
    return (real.select(*cols).withColumn("src", F.lit(0))
            .unionByName(syn.select(*cols).withColumn("src", F.lit(1))))


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None) -> DataFrame:
    """Range-partition on (keys, order) and stamp each row with its slice id.

    The stamped frame is checkpointed (reliably, into spark.checkpoint.dir):
    range bounds come from a sample whose outcome can differ between two
    evaluations, so both consumers must read one materialised copy.  This also
    cuts the lineage, so a lost executor does not replay the upstream shuffle.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(n, *[F.col(k) for k in keys], *[F.col(o) for o in order]).withColumn(
        "_slice", F.spark_partition_id())
    return cut_lineage(sliced)


# A key with at most this many rows is processed by one window task (it fits
# easily in one executor); larger keys go through the range-sliced path.
SINGLE_TASK_ROWS = 2_000_000


# Values of a column that are joined broadcast at most.
BROADCAST_VALUES = 10_000


def _fits_one_task(df: DataFrame, keys: Sequence[str], limit: int | None, largest: int | None = None) -> bool:
    """Size check: is the largest ``keys`` group (``largest`` rows, if known) small enough for one task?"""
    limit = SINGLE_TASK_ROWS if limit is None else limit
    if limit <= 0:
        return False
    if largest is not None:
        return largest <= limit
    biggest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (biggest or 0) <= limit


def prefix_sum(df: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str],
               next_value: bool = False, partitions: int | None = None,
               single_task_rows: int | None = None) -> DataFrame:
    """Inclusive running sums of ``weights`` within ``keys`` ordered by ``order``.

    ``order`` must be unique within ``keys`` (aggregate to value counts first).
    Adds ``cum_<w>`` per weight and, if asked, ``next_<order>`` (the following
    value within the key, null for the last).  No task ever holds a whole key.
    """
    keys = list(keys)
    if _fits_one_task(df, keys, single_task_rows):
        w_key = Window.partitionBy(*keys).orderBy(order)
        return df.select(*df.columns,
                         *[F.sum(w).over(w_key.rowsBetween(Window.unboundedPreceding, 0)).alias(f"cum_{w}") for w in weights],
                         *([F.lead(order).over(w_key).alias(f"next_{order}")] if next_value else []))
    sliced = _slices(df, keys, [order], partitions)
    per_slice = sliced.groupBy("_slice", *keys).agg(
        *[F.sum(w).alias(f"_tot_{w}") for w in weights], F.min(order).alias("_first"))
    w_slices = Window.partitionBy(*keys).orderBy("_slice")
    before = w_slices.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        "_slice", *keys,
        *[F.coalesce(F.sum(f"_tot_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weights],
        F.lead("_first").over(w_slices).alias("_next_first"))
    w_local = Window.partitionBy("_slice", *keys).orderBy(order)
    local = sliced.select(
        *df.columns, "_slice",
        *[F.sum(w).over(w_local.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_run_{w}") for w in weights],
        *([F.lead(order).over(w_local).alias("_next_local")] if next_value else []))
    # offsets has one row per (slice, key); with many keys it is not small, so
    # the join strategy is left to AQE's runtime size check.
    joined = local.join(offsets, ["_slice", *keys])
    out_cols = [*df.columns, *[(F.col(f"_run_{w}") + F.col(f"_off_{w}")).alias(f"cum_{w}") for w in weights]]
    if next_value:
        out_cols.append(F.coalesce(F.col("_next_local"), F.col("_next_first")).alias(f"next_{order}"))
    return joined.select(*out_cols)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank",
                partitions: int | None = None, single_task_rows: int | None = None, largest: int | None = None) -> DataFrame:
    """Exact 0-based row_number within ``keys`` by ``order`` without a global sort task.

    Ties in ``order`` are broken by a per-row id taken from the input scan;
    tied rows must be interchangeable (e.g. identical rows). ``largest``: rows of the largest group, if known.
    """
    keys = list(keys)
    tagged = df.withColumn("_one", F.lit(1)).withColumn("_tie", F.monotonically_increasing_id())
    ordcols = list(order) + ["_tie"]
    if _fits_one_task(df, keys, single_task_rows, largest):
        w_key = Window.partitionBy(*keys).orderBy(*ordcols)
        return tagged.select(*df.columns, (F.row_number().over(w_key) - 1).cast("bigint").alias(name))
    sliced = _slices(tagged, keys, ordcols, partitions)
    per_slice = sliced.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_tot"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("_slice", *keys, F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    local = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*ordcols)))
    joined = local.join(offsets, ["_slice", *keys])
    return joined.select(*df.columns, (F.col("_rn") - 1 + F.col("_off")).cast("bigint").alias(name))


def dense_index(df: DataFrame, order: Sequence[str] | Column, name: str = "_idx",
                single_task_rows: int | None = None) -> DataFrame:
    """0..N-1 index in ``order`` (one group); ties only among interchangeable rows."""
    order_cols = [order] if isinstance(order, str) else list(order)
    return rank_within(df.withColumn("_g", F.lit(0)), ["_g"], order_cols, name,
                       single_task_rows=single_task_rows).drop("_g")


def hash_index(df: DataFrame, uniform: str, name: str = "_idx", buckets: int = 1024, single_task_rows: int | None = None) -> DataFrame:
    """0..N-1 in the order of ``uniform``, a hash in [0, 1); ties only among interchangeable rows.

    Rows are ranked inside buckets of hashes, and a bucket's first rank is the number of rows before it.
    """
    held = df.withColumn("_b", F.least(F.floor(F.col(uniform) * buckets), F.lit(buckets - 1)).cast("int"))
    sizes = cut_lineage(held.groupBy("_b").agg(F.count(F.lit(1)).alias("_k")).withColumn("_g", F.lit(0)))  # one pass for ranks and size check
    first = sizes.select("_b", (F.sum("_k").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_k")).alias("_first"))  # ``buckets`` rows
    ranked = rank_within(held, ["_b"], [uniform], name, single_task_rows=single_task_rows, largest=sizes.agg(F.max("_k")).first()[0] or 0)
    return ranked.join(first, "_b").withColumn(name, F.col(name) + F.col("_first")).drop("_b", "_first")


def join_scores(wide: DataFrame, scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each value of ``columns`` in ``wide`` replaced by its score, the other columns first; ``scores``: (col, v, score), one row per value. Without one: null.

    One join by value per column, on rows that stay whole, instead of a long form put together again by row id. A column
    of few values joins broadcast; in others adaptive execution splits the rows of a hot value over tasks.
    """
    scores = written(scores)
    sizes = {r["col"]: r["n"] for r in scores.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = wide
    for i, c in enumerate(columns):
        own = scores.where(F.col("col") == c).select(F.col("v").alias("_v"), F.col("score").alias(f"_s{i}"))
        own = F.broadcast(own) if sizes.get(c, 0) <= BROADCAST_VALUES else own
        out = out.join(own, F.col(c) == F.col("_v"), "left").drop("_v", c)
    others = [F.col(c) for c in wide.columns if c not in columns]
    return out.select(*others, *[F.col(f"_s{i}").alias(c) for i, c in enumerate(columns)])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many tasks as the session shuffles to (at least one per core), whatever their size.

    For work that costs much per row: adaptive execution would size its tasks by bytes.
    """
    return df.repartition(spread_tasks(df.sparkSession))


def deal(df: DataFrame, rows: int) -> DataFrame:
    """``df`` written once, in evenly filled tasks: one per core, with at least ``rows`` rows each.

    For fits that read it many times. Their tasks send a summary each, so more than one per core would only cost more.
    A table of at most ``rows`` rows stays as it lies.
    """
    held = cut_lineage(df)
    n = held.count()
    return held if n <= rows else cut_lineage(held.repartition(min(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows))))


def spread_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def expand_counts(df: DataFrame, count_col: str, chunk: int = 4096) -> DataFrame:
    """Repeat each row ``count_col`` times, spreading big repeats over tasks.

    A row repeated m times first becomes ceil(m / chunk) chunk rows, which are
    repartitioned before the final explode, so one hot row never lands in a
    single task.
    """
    others = [c for c in df.columns if c != count_col]
    chunks = df.where(F.col(count_col) > 0).select(
        *others, F.col(count_col).alias("_m"),
        F.explode(F.sequence(F.lit(0), F.ceil(F.col(count_col) / F.lit(chunk)).cast("int") - 1)).alias("_chunk"))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(n_parts, F.xxhash64(*[F.col(c) for c in others], F.col("_chunk")))
    return spread.select(
        *others,
        F.explode(F.sequence(F.col("_chunk") * chunk,
                             F.least(F.col("_m"), (F.col("_chunk") + 1) * chunk).cast("int") - 1)).alias("_copy")
    ).drop("_copy")


def lag_over(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
             partitions: int | None = None, single_task_rows: int | None = None) -> DataFrame:
    """Previous row's values (``prev_<c>``) within ``keys`` ordered by ``order``.

    Skew-safe: rows are range-sliced on (keys, order); the first row of each
    slice takes the last row of the previous non-empty slice of its key from a
    table of O(slices x keys) rows.
    """
    keys = list(keys)
    if _fits_one_task(df, keys, single_task_rows):
        w_key = Window.partitionBy(*keys).orderBy(order)
        return df.select(*df.columns, *[F.lag(c).over(w_key).alias(f"prev_{c}") for c in columns])
    sliced = _slices(df, keys, [order], partitions)
    w = Window.partitionBy("_slice", *keys).orderBy(order)
    local = sliced.select("*", F.row_number().over(w).alias("_pos"),
                          *[F.lag(c).over(w).alias(f"_lag_{c}") for c in columns])
    last = sliced.groupBy("_slice", *keys).agg(*[F.max_by(c, order).alias(f"_last_{c}") for c in columns])
    prev = last.select("_slice", *keys, *[F.lag(f"_last_{c}").over(Window.partitionBy(*keys).orderBy("_slice"))
                                          .alias(f"_prev_{c}") for c in columns])
    joined = local.join(prev, ["_slice", *keys])
    return joined.select(*df.columns, *[F.when(F.col("_pos") == 1, F.col(f"_prev_{c}")).otherwise(F.col(f"_lag_{c}"))
                                        .alias(f"prev_{c}") for c in columns])


def ffill_over(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
               partitions: int | None = None, single_task_rows: int | None = None) -> DataFrame:
    """Forward fill ``columns`` within ``keys`` by ``order`` (leading nulls stay null)."""
    keys = list(keys)
    if _fits_one_task(df, keys, single_task_rows):
        w_key = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        others = [c for c in df.columns if c not in columns]
        return df.select(*others, *[F.last(c, ignorenulls=True).over(w_key).alias(c) for c in columns]).select(*df.columns)
    sliced = _slices(df, keys, [order], partitions)
    w = Window.partitionBy("_slice", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_ff_{c}") for c in columns])
    last = sliced.groupBy("_slice", *keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_lnn_{c}") for c in columns])
    carry_w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("_slice", *keys, *[F.last(f"_lnn_{c}", ignorenulls=True).over(carry_w).alias(f"_carry_{c}")
                                           for c in columns])
    joined = local.join(carry, ["_slice", *keys])
    others = [c for c in df.columns if c not in columns]
    return joined.select(*others, *[F.coalesce(F.col(f"_ff_{c}"), F.col(f"_carry_{c}")).alias(c) for c in columns]).select(*df.columns)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    single_task_rows: int | None = None, weight: str | None = None) -> DataFrame:
    """numpy-style (linear) quantiles of ``value`` per ``keys``: (keys..., p, q). ``weight``: how many rows a row stands for.

    Values are reduced to counts; order statistics are located through a
    distributed prefix sum and a (keys x probs) target table.
    """
    keys = list(keys)
    spark = df.sparkSession
    # counted once: the size check, the slices and the totals below all read these counts
    vc = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_k")))
    ps = prefix_sum(vc, keys, "_v", ["_k"], single_task_rows=single_task_rows)
    sizes = vc.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    targets = (sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .withColumn("_h", (F.col("_n") - 1) * F.col("p"))
               .withColumn("_klo", F.floor("_h").cast("bigint"))
               .withColumn("_khi", F.least(F.col("_klo") + 1, F.col("_n") - 1))
               .withColumn("_frac", F.col("_h") - F.col("_klo")))
    ks = targets.select(*keys, "p", F.col("_klo").alias("_kk")).unionByName(
        targets.select(*keys, "p", F.col("_khi").alias("_kk"))).distinct()
    support = ps.select(*keys, "_v", (F.col("cum__k") - F.col("_k")).alias("_lo"), F.col("cum__k").alias("_hi"))
    found = cut_lineage(support.join(ks, keys).where((F.col("_kk") >= F.col("_lo")) & (F.col("_kk") < F.col("_hi"))))  # a row per key and p
    lo = found.select(*keys, "p", F.col("_kk").alias("_klo"), F.col("_v").alias("_vlo"))
    hi = found.select(*keys, "p", F.col("_kk").alias("_khi"), F.col("_v").alias("_vhi"))
    return (targets.join(lo, [*keys, "p", "_klo"]).join(hi, [*keys, "p", "_khi"])
            .select(*keys, "p", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("q")))
