"""Shared helpers: text rows, ordered slices of a table, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.session import checkpoint_dir


#: Rows and bytes of one Arrow batch at most: long texts in 10,000 rows would fill a worker's memory.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, where its own bounds aren't lower."""
    for key, most in _BATCH.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_shared_folder(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and read it back.

    Cuts the lineage with files that every executor sees, so a lost executor
    costs no recomputation of what stands before.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slice_bounds(df: DataFrame, key: str, slices: int) -> list[int]:
    """Ascending integer keys of ``df`` that open slices 1, 2, ... of about equal row counts.

    Reads the key column only; at most ``slices - 1`` values come back.
    """
    if slices < 2:
        return []
    at = [i / slices for i in range(1, slices)]
    got = df.agg(F.percentile_approx(key, at, 10 * slices).alias("b"), F.min(key).alias("low")).first()
    return sorted(x for x in set(got.b or []) if x > got.low)


def slice_of(key: str, bounds: list[int]):
    """Number of bounds that are not above the key: binary search as one expression. Null keys: slice 0."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    arr, n = F.array(*[F.lit(b).cast("bigint") for b in bounds]), len(bounds)

    def step(pos, s):
        return F.when((pos + s <= n) & (F.get(arr, pos + s - 1) <= F.col(key)), pos + s).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system after each partition: workers are reused and would keep it.

    What the partition left in reference cycles is collected first, else it lives on beside the next partition's.
    """

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return then_release


def strings(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's values as UTF-8 bytes; null: empty."""
    col = batch.column(name)
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]
