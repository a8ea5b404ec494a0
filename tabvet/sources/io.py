"""Reading, validating and writing tables; run records and the run log."""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.exprs import hash52, row_key

# Fixed value: minimum rows a table must have before it is profiled.
MIN_ROWS = 20


class InvalidTableError(ValueError):
    """The input table cannot be used (empty, too narrow, duplicate names...)."""


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (header, typed, fail fast) or Parquet by suffix; names stripped."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        reader = spark.read.option("header", True).option("mode", "FAILFAST")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        try:
            df = reader.csv(path)
        except Exception as exc:  # parse errors surface as a clear dataset error
            raise InvalidTableError(f"could not read CSV: {exc}") from exc
    elif lower.endswith(".parquet") or lower.endswith(".pq"):
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    else:
        raise InvalidTableError("only .csv and .parquet tables are supported")
    stripped = [c.strip() for c in df.columns]
    if any(not c for c in stripped):
        raise InvalidTableError("empty column names are not supported")
    if len(set(stripped)) != len(stripped):
        raise InvalidTableError("duplicate column names are not supported")
    return df.toDF(*stripped)


def validate_table(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """S3: non-empty, >= 2 columns, >= min_rows rows; names stripped, no duplicates.

    Counts only up to ``min_rows`` (a LIMIT), never the whole table.
    """
    if len(df.columns) < 2:
        raise InvalidTableError("the table must have at least two columns")
    stripped = [c.strip() for c in df.columns]
    if len(set(stripped)) != len(stripped):
        raise InvalidTableError("duplicate column names are not supported")
    seen = df.limit(max(min_rows, 1)).count()
    if seen == 0:
        raise InvalidTableError("the table is empty")
    if seen < min_rows:
        raise InvalidTableError(f"the table has {seen} rows; at least {min_rows} are required")
    return df.toDF(*stripped)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    """Write a (synthetic) table; CSV gets a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def write_run_record(spark: SparkSession, path: str, run_id: str, status: str, config: dict,
                     dataset_hash: str | None = None, failure_type: str | None = None,
                     failure_message: str | None = None) -> DataFrame:
    """One-row JSON manifest; status in running/completed/failed."""
    if status not in {"running", "completed", "failed"}:
        raise ValueError(f"unknown run status {status!r}")
    row = [(run_id, status, json.dumps(config, sort_keys=True, default=str), dataset_hash, failure_type,
            failure_message, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))]
    rec = spark.createDataFrame(row, RUN_RECORD_SCHEMA)
    rec.coalesce(1).write.mode("append").json(path)
    return rec


RUN_RECORD_SCHEMA = ("run_id string, status string, config string, dataset_hash string, "
                     "failure_type string, failure_message string, at timestamp")


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``, one row each."""
    return spark.read.schema(RUN_RECORD_SCHEMA).json(path)


def write_split_ids(split: DataFrame, path: str, ids: Sequence[str], by: str = "split") -> str:
    """Which part each row of a run went to, as a table partitioned by part, so that one part is read alone."""
    split.select(*ids, by).write.partitionBy(by).parquet(path)
    return path


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows in a stable order (a top-n: each task keeps n rows)."""
    return df.orderBy(*order_by).limit(n)


def preview_json(df: DataFrame) -> DataFrame:
    """Each row as JSON with nulls kept as null."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def dataset_fingerprint(df: DataFrame, generator: str, seed: int) -> DataFrame:
    """Order-insensitive content hash, row count, schema, generator, seed.

    Each row is md5-hashed (stable value forms), the 52-bit prefixes are summed
    modulo 2^52: any row order and any partitioning give the same value.
    """
    h = hash52(row_key(df))
    agg = df.agg(F.count(F.lit(1)).cast("bigint").alias("num_rows"),
                 F.sum(h.cast("decimal(38,0)")).alias("_s"))
    return agg.select(
        F.pmod(F.col("_s"), F.lit(2**52).cast("decimal(38,0)")).cast("bigint").alias("dataset_hash"),
        "num_rows",
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(df.schema.simpleString()).alias("schema"),
        F.lit(generator).alias("generator"),
        F.lit(int(seed)).cast("bigint").alias("random_seed"))


# ---- S12: append-only run log -------------------------------------------------

RUN_LOG_SCHEMA = "run_id string, event string, status string, payload string, at timestamp"
OPEN_STATUSES = ("queued", "running")


def run_log_append(spark: SparkSession, path: str, run_id: str, event: str, status: str,
                   payload: dict | None = None, at: _dt.datetime | None = None) -> None:
    """Append one stage event; the log is never rewritten."""
    stamp = at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(run_id, event, status, json.dumps(payload or {}, sort_keys=True, default=str), stamp)],
                          RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run_log_latest(events: DataFrame) -> DataFrame:
    """Latest state per run: last event by time (ties: event name, status, payload), plus creation time.

    One aggregate that combines before the shuffle, however many events a run has.
    """
    last = F.max(F.struct("at", "event", "status", "payload"))
    runs = events.groupBy("run_id").agg(last.alias("last"), F.min("at").alias("created_at"), F.count(F.lit(1)).alias("n_events"))
    return runs.select("run_id", "last.event", "last.status", "last.payload", "last.at", "created_at", "n_events")


def run_log_list(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first; limit clamped to 1..500."""
    limit = max(1, min(int(limit), 500))
    return run_log_latest(events).orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit)


def run_log_recover(spark: SparkSession, path: str, events: DataFrame | None = None) -> int:
    """Mark queued/running runs as failed (after a restart); returns how many."""
    events = events if events is not None else spark.read.parquet(path)
    stale = run_log_latest(events).where(F.col("status").isin(*OPEN_STATUSES)).select("run_id")
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    marks = stale.select("run_id", F.lit("recovered").alias("event"), F.lit("failed").alias("status"),
                         F.lit(json.dumps({"reason": "interrupted"})).alias("payload"),
                         F.lit(now).cast("timestamp").alias("at"))
    marks = marks.cache()
    n = marks.count()
    if n:
        marks.write.mode("append").parquet(path)
    marks.unpersist()
    return n
