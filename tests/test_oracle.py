import os

import duckdb
import pandas as pd
import pytest
from sedimenta import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


def plain(frame):
    cell = lambda x: "null" if pd.isna(x) else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(map(tuple, frame[sorted(frame.columns)].map(cell).to_numpy().tolist()))


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    spark.catalog.clearCache()
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, con, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
