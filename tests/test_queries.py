"""Queries against their SQL on the smallest tables, where those are there."""

import os

import duckdb
import pytest

from tramline import queries, synth

DIR = "/root/testdata/sf0.001"
NAMES = sorted(queries.ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    assert got == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_views_keep_every_row(spark):
    """calendar_dates and the like: one projected row for each row of the source, so no rule and no SQL sees a part of a table."""
    source = {"calendar_dates": "events", "frequencies": "events", "timeframes": "events", "transfers": "events", "pathways": "part", "fare_attributes": "customer", "fare_rules": "customer", "route_networks": "customer", "location_group_stops": "part"}
    for table, name in source.items():
        assert synth.view(spark, DIR, table).count() == spark.read.parquet(f"{DIR}/{name}.parquet").count(), table
