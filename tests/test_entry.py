"""Every registered query with an oracle equals it on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def shown(rows):
    number = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr(sorted((k, number(v)) for k, v in r.items())) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.catalogue.QUERIES))
def test_query(spark, oracle, name):
    rows = entry.queries()[name](spark, DATA).toArrow().to_pylist()
    assert rows
    if name in entry.oracle_sql():
        found = oracle.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        assert shown(rows) == shown(dict(zip(columns, r)) for r in found.fetchall())
