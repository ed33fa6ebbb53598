"""Every query with an oracle matches DuckDB at sf0.001 (the driver's gate
runs the same comparison at sf0.01)."""

import collections
import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001
from tabsmith.sources.tables import TABLES

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    sdf = QUERIES[name](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _bag(sdf.columns, srows) == _bag(dcols, drows)


def test_every_query_registered_has_callable():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 8
    assert df.columns == ["ordinal", "column", "dtype", "missing", "missing_pct", "n_rows",
                          "n_columns", "duplicate_rows"]
