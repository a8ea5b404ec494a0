"""Real/synthetic pairs and other inputs derived from the driver tables.

The standard pair splits ``lineitem`` into two disjoint halves by the md5
parity of ``l_orderkey``; together they are the whole table, so every metric
runs over all rows.  DuckDB reproduces the split with the same md5 prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.functions.exprs import hash52
from tabvet.sources.io import load_table

PAIR_COLUMNS = ["l_quantity", "l_extendedprice", "net_price", "l_discount", "l_tax",
                "l_linenumber", "l_returnflag", "l_linestatus"]


def lineitem_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = load_table(spark, sf_dir, "lineitem")
    half = hash52(F.col("l_orderkey").cast("string")) % 2
    base = li.select(
        "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("net_price"),
        "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", half.alias("_half"))
    real = base.where(F.col("_half") == 0).drop("_half")
    syn = base.where(F.col("_half") == 1).drop("_half")
    return real, syn


def lineitem_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair's columns of every row of ``lineitem``."""
    li = load_table(spark, sf_dir, "lineitem")
    return li.withColumn("net_price", F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).select(*PAIR_COLUMNS)


def documents_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to document features (doc_id, lang, source, n_chars, quality, toxic)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = load_table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id")


def lineitem_full_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All lineitem columns, split into the same two md5-parity halves."""
    li = load_table(spark, sf_dir, "lineitem")
    half = hash52(F.col("l_orderkey").cast("string")) % 2
    base = li.withColumn("_half", half)
    return base.where(F.col("_half") == 0).drop("_half"), base.where(F.col("_half") == 1).drop("_half")


def lineitem_thirds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair columns split into thirds by md5 of l_orderkey: train, holdout, synthetic."""
    li = load_table(spark, sf_dir, "lineitem")
    third = hash52(F.col("l_orderkey").cast("string")) % 3
    base = li.select(
        "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("net_price"),
        "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", third.alias("_t"))
    return tuple(base.where(F.col("_t") == i).drop("_t") for i in range(3))


def labeled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled documents with a rule prediction (long documents predicted as quality 1)."""
    return documents_labeled(spark, sf_dir).withColumn(
        "predicted", (F.col("n_chars") >= 2000).cast("int"))


def priced_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a list-price estimate quantity x retail price from ``part``."""
    li = load_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    part = load_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(part, "l_partkey").withColumn("estimate", F.col("l_quantity") * F.col("p_retailprice"))


def event_grid(spark: SparkSession, sf_dir: str, fill: bool = True) -> DataFrame:
    """Regular hourly series per event_type, zero-filled: (event_type, hour, n_events, value_sum).

    The spine runs from each type's first to last occupied hour, so the grid
    is regular by construction (the explicit regularisation the sequence
    operators require).  Without ``fill``, value_sum is null in hours without events.
    """
    ev = load_table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), "value")
    hourly = ev.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value_sum"))
    bounds = ev.groupBy("event_type").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = bounds.select("event_type", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return spine.join(hourly, ["event_type", "hour"], "left").select(
        "event_type", "hour", F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"),
        F.coalesce("value_sum", F.lit(0.0)).alias("value_sum") if fill else F.col("value_sum"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the log of runs: a user is a run, an event type a stage with a status."""
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "purchase", "completed").otherwise("running"))
    return load_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("event"), status.alias("status"),
        F.col("props").alias("payload"), F.col("ts").alias("at"))


def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate metric row per document ``source`` (all scores in [0, 1]).

    A stand-in candidate table computed from the data so that gates, Pareto
    fronts and selection run over table-derived rows: each source plays the
    role of one candidate synthetic table.
    """
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = load_table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    total = docs.agg(F.count(F.lit(1)).alias("n_total"), F.avg("n_chars").alias("avg_all"), F.max("n_chars").alias("max_all"),
                     F.count_distinct("lang").alias("n_langs"))
    lang_all = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("k_all"))
    lang_src = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("k"))
    n_src = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # TV over all languages without pairing every source with every language:
    # sum_all |p - q| = sum_present |p - q| + (1 - sum_present q)
    q = F.col("k_all") / F.col("n_total")
    tv = (lang_src.join(lang_all, "lang").join(n_src, "source").crossJoin(total)  # total is one row
          .groupBy("source").agg((F.lit(1.0) - F.lit(0.5) * (F.sum(F.abs(F.col("k") / F.col("n") - q))
                                                             + F.lit(1.0) - F.sum(q))).alias("distribution_score")))
    per = d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("u"), F.avg((F.col("n_chars") >= 50).cast("double")).alias("validity"),
        F.avg("toxic").alias("toxic"), F.avg("quality").alias("quality"), F.count_distinct("lang").alias("langs"),
        F.avg("n_chars").alias("avg_chars"), F.stddev_pop("n_chars").alias("sd_chars"))
    j = per.join(tv, "source").crossJoin(total)  # total is one row
    r = lambda c: F.round(c, 6)
    return j.select(
        F.col("source").alias("candidate_id"),
        r(F.lit(1.0) - F.col("u") / F.col("n")).alias("exact_match_rate"),
        r(F.col("u") / F.col("n")).alias("diversity_score"),
        r(F.col("validity")).alias("validity_score"),
        r(F.lit(1.0) - F.coalesce(F.col("toxic"), F.lit(0.0))).alias("privacy_score"),
        r(F.coalesce(F.col("quality"), F.lit(0.0))).alias("utility"),
        r(F.col("langs") / F.col("n_langs")).alias("dependency_score"),
        r(F.col("distribution_score")).alias("distribution_score"),
        r(F.lit(1.0) - F.abs(F.col("avg_chars") - F.col("avg_all")) / F.col("max_all")).alias("multivariate_score"),
        r(F.least(F.lit(1.0), F.col("sd_chars") / F.col("avg_chars"))).alias("discriminator_score"),
        (F.col("distribution_score") >= 0.55).alias("passed"),
        (F.col("n") / 1000.0).alias("cost_seconds"))
