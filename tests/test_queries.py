"""Every query that has SQL gives the rows that DuckDB gives."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from spindle.queries import QUERIES, SQL
from spindle.sources.catalog import TABLES

SF = "/root/testdata/sf0.01"


def _plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
