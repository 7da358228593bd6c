"""Every registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from veilspark.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    result = duck.execute(f"SELECT {listed} FROM ({ORACLES[name]})")
    want = sorted(map(repr, result.fetchall()))
    assert got == want and got
