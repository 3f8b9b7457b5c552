import os

import duckdb
import pytest

import oracle_check
from graphloom.llm.queries import QUERIES
from graphloom.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# The columns that the found queries have to have.
COLUMNS = {
    "p1_found": ["row_id", "canonical"], "p2_found": ["chunk_id"], "p3_found": ["record_table", "first_id", "row_id"],
    "p4_found": ["chunk_id", "char_start", "char_end"], "p6_found": ["vector_table", "id_a", "id_b"], "p7_found": ["first_id", "row_id"],
    "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    columns = sorted(df.columns)
    got = sorted((tuple(oracle_check.plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        want = sorted((tuple(oracle_check.plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
        assert got == want
