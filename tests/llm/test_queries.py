"""The package's queries on the smallest tables: columns, rows once, and SQL where there is some."""

import os

import duckdb
import pytest

from treeloom.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
COLUMNS = {"p1_found": ["symbol", "kind", "mark"], "p3_found": ["file"], "p4_found": ["id", "line_no"], "p5_found": ["path"], "p6_found": ["id"], "p10_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs(spark, name):
    rows = [str(r) for r in registry.QUERIES[name](spark, DIR).collect()]
    if name in COLUMNS:
        assert registry.QUERIES[name](spark, DIR).columns == COLUMNS[name]
        assert len(rows) == len(set(rows)) and rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("symbols", "documents"):
        con.sql(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    picked = ", ".join(df.columns)
    assert sorted(map(str, [tuple(r) for r in df.collect()])) == sorted(map(str, con.sql(f"select {picked} from ({registry.SQL[name]}) x").fetchall()))
