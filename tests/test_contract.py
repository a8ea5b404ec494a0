"""Driver contract: entry, queries and oracle SQL line up."""

import duckdb

import __spark_entry__ as entry
from tests.conftest import SF


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100 or len(q) >= 80


def test_oracles_parse_in_duckdb():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")


def test_entry_runs_on_smallest_scale(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["metric", "value"] and len(rows) == 8
    assert {r.metric for r in rows} >= {"fidelity_score", "privacy_score", "validity_score", "passed"}
