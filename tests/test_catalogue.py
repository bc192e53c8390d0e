"""Every registered query of the library proper against its DuckDB oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexiforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    got = [r.asDict() for r in rows.collect()]
    if name in catalogue.oracles():
        want = duck.sql(catalogue.oracles()[name])
        assert sorted(rows.columns) == sorted(want.columns)
        columns = sorted(rows.columns)
        assert sorted(tuple(plain(r[c]) for c in columns) for r in got) == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
