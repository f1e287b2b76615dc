"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(frame):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(int(v)) if v == int(v) else repr(round(v, 6))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in frame)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for name in os.listdir(DIR):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n[:2] in ("p1", "p3", "p4", "p5", "p6", "p8", "p9")))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    expected = db.sql(entry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows(df.select(*columns).collect()) == rows(db.sql(f"select {picked} from ({entry.oracle_sql()[name]}) x").fetchall())


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["path", "snapshot_no", "change"]
