"""Every registered query with SQL gives the same values as the SQL, on the smallest tables."""
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as contract  # noqa: E402
from check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toArrow()
    assert compare(got, con.execute(contract.oracle_sql()[name]).to_arrow_table()) == "exact"


def test_entry(spark):
    df = contract.entry(spark)
    assert len(df.columns) == 38 and df.count() > 0
