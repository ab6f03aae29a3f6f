"""Registered queries against their SQL counterparts on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rungwise.workload import catalogue

# All of them; RUNGWISE_QUERIES="prefix prefix" picks some. Text queries have tests of their own.
ORACLES = {name: text for name, (_, text) in catalogue.all_queries().items() if text}
CHOSEN = tuple(os.environ.get("RUNGWISE_QUERIES", "").split())
NAMES = [n for n in ORACLES if not CHOSEN or n.startswith(CHOSEN)]


def plain(value):
    return 0.0 if isinstance(value, float) and value == 0 else value


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(small_dir):
        con.execute(f"create view {name[:-8]} as select * from '{small_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small_dir, duck, name):
    frame = entry.queries()[name](spark, small_dir)
    columns = sorted(frame.columns)
    got = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    result = duck.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = sorted(range(len(found)), key=lambda i: found[i])
    want = [tuple(plain(row[i]) for i in order) for row in result.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_query_has_sql():
    assert set(catalogue.all_queries()) == set(ORACLES)
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 7
