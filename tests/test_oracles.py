"""Every core query against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from airgrid.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = rows(registry.QUERIES[name](spark, D).toPandas()), rows(con.execute(registry.ORACLE_SQL[name]).df())
    assert got == want
    assert got[1], "no rows compared"


def test_queries_hold_every_row(spark):
    n = spark.read.parquet(f"{D}/events.parquet").count()
    lines = spark.read.parquet(f"{D}/events.parquet").select("user_id").distinct().count()
    assert registry._lines(spark, D).count() == n
    assert registry.QUERIES["turn_penalty"](spark, D).count() == n - 2 * lines
    assert registry.QUERIES["nearest_cell"](spark, D).count() == spark.read.parquet(f"{D}/customer.parquet").count()
    assert registry.QUERIES["ring_centres"](spark, D).count() == registry.NX * registry.NY
