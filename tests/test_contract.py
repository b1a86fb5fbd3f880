"""The driver contract: names, SQL, and a few queries against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "orders", "lineitem", "events"]
SAMPLE = ["min_flows_filter", "split_random_flows", "ewma_zscore", "host_age", "role_context", "identity_probe", "summary_metrics", "sessionize", "log_loss"]


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert len(names) > 140 and set(sql) <= set(names)
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
