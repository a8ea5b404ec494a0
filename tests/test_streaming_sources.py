"""Sources/sinks and the streaming wrapper."""

import os
import tempfile

import pytest

from tabvet.operators import constraints as cons
from tabvet.sources import io as sio
from tabvet.streaming import foreach_batch_checks


def test_csv_and_parquet_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tabvet-io-")
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(25)], "id int, name string, v double")
    sio.write_table(df, os.path.join(d, "t.csv"), fmt="csv")
    back = sio.validate_table(sio.read_table(spark, os.path.join(d, "t.csv")))
    assert back.count() == 25 and back.columns == ["id", "name", "v"]
    with pytest.raises(sio.InvalidTableError):
        sio.read_table(spark, os.path.join(d, "t.txt"))
    with pytest.raises(sio.InvalidTableError):
        sio.validate_table(df.limit(5))


def test_fingerprint_is_order_insensitive(spark):
    df = spark.range(100).selectExpr("id", "id * 2 as v")
    a = sio.dataset_fingerprint(df.repartition(5), "g", 1).first()
    b = sio.dataset_fingerprint(df.orderBy("v").coalesce(1), "g", 1).first()
    assert a.dataset_hash == b.dataset_hash and a.num_rows == 100


def test_run_log_latest_and_recover(spark):
    import datetime as dt
    path = tempfile.mkdtemp(prefix="tabvet-log-") + "/log"
    t0 = dt.datetime(2024, 1, 1)
    sio.run_log_append(spark, path, "r1", "created", "running", at=t0)
    sio.run_log_append(spark, path, "r1", "finished", "completed", at=t0 + dt.timedelta(minutes=1))
    sio.run_log_append(spark, path, "r2", "created", "queued", at=t0 + dt.timedelta(minutes=2))
    events = spark.read.parquet(path)
    latest = {r.run_id: r.status for r in sio.run_log_latest(events).collect()}
    assert latest == {"r1": "completed", "r2": "queued"}
    assert [r.run_id for r in sio.run_log_list(events, 1000).collect()] == ["r2", "r1"]
    assert sio.run_log_recover(spark, path) == 1
    assert {r.run_id: r.status for r in sio.run_log_latest(spark.read.parquet(path)).collect()}["r2"] == "failed"


def test_foreach_batch_checks(spark):
    base = tempfile.mkdtemp(prefix="tabvet-stream-")
    real = spark.createDataFrame([(20, "A"), (30, "B"), (40, "A"), (50, "B")], "age int, segment string")
    rules = cons.discover_constraints(real)
    src = os.path.join(base, "in")
    spark.createDataFrame([(19, "A"), (60, "C")], "age int, segment string").write.parquet(src)
    stream = spark.readStream.schema("age int, segment string").parquet(src)
    q = foreach_batch_checks(stream, rules, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    out = {(r.column_name, r.kind): r.violations for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    assert out[("age", "min")] == 1 and out[("age", "max")] == 1 and out[("segment", "allowed_categories")] == 1
