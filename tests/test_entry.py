import os

import duckdb
import pytest

import __spark_entry__ as entry
import oracle_check
from graphloom.plans import graph_queries, orphan_queries

FOLDER = "/root/testdata/sf0.001"
CORE = {**graph_queries.QUERIES, **orphan_queries.QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_against_sql(spark, con, name):
    df = CORE[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(oracle_check.plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(oracle_check.plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())
    assert entry.entry(spark).columns == ["ref_table", "ref_field", "row_id", "ref_key"]


def test_core_does_not_import_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "graphloom")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert "graphloom.llm" not in text, f


def test_workers_find_the_package(spark):
    query = entry.queries()["doc_sha256"]
    spark.sparkContext.environment.pop("PYTHONPATH", None)
    query(spark, FOLDER)
    query(spark, FOLDER)
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert spark.sparkContext.environment["PYTHONPATH"] == root
