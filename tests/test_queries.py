"""Every query with SQL gives what DuckDB gives."""

import datetime
import os

import duckdb
import pytest

from quarry import registry
from quarry.plans import change_queries, core_queries, function_queries, more_queries, statement_queries  # noqa: F401
from quarry.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date()
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    found = rows(got.columns, got.collect())
    if name in registry.SQL:
        cur = duck.execute(registry.SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(got.columns)
        assert found == rows(names, cur.fetchall())
