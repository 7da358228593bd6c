"""The registered queries against SQL, and the pipeline against its stages."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from veilspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def test_all_are_registered():
    names = entry.queries().keys()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "pipeline" in names


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(map(repr, want)) and got


# op12 gives rows per (anchor, positive, negative) and op13 per word, by their
# contracts; their own tests hold them against brute force
PER_DOCUMENT = [n for n in QUERIES if n not in ORACLES and not n.startswith(("op12_", "op13_"))]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_row(spark, name):
    table = "conversations" if name.startswith("op10") else "documents"
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert QUERIES[name](spark, FOLDER).count() == n


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        before = docs
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.count() == docs.count()
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
