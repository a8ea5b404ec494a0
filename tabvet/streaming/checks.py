"""Batch checks applied per micro-batch of a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.operators.constraints import constraint_violations


def foreach_batch_checks(stream: DataFrame, rules: DataFrame, output_path: str, checkpoint_location: str,
                         trigger_once: bool = True):
    """Start a query that appends C2 violation counts of each micro-batch to ``output_path``.

    ``rules`` come from the real table (``discover_constraints``); they are
    collected once per batch (a few rows).  The checkpoint location must be on
    shared storage so the query restarts exactly where it stopped.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        counts = constraint_violations(batch, rules).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        counts.write.mode("append").parquet(output_path)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
