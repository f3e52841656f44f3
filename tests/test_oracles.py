"""Every change-stream query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest
from compare import rows_of, rows_of_sql


from changeloom.plans import catalog

SF_SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = rows_of(QUERIES[name](spark, SF_SMALL))
    if name in ORACLES:
        assert found == rows_of_sql(con, ORACLES[name])
    else:
        assert found[1]
