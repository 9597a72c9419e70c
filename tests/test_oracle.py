"""Core queries against their SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import verify
from rungwork.plans import registry

SF = os.environ.get("RUNGWORK_TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    res = con.execute(registry.oracle_sql()[name])
    assert verify.rows_of(df.columns, df.collect()) == verify.rows_of([d[0] for d in res.description], res.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
