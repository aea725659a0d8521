"""Every query with checking SQL gives what DuckDB gives on the same tables."""

import importlib

import pytest
from oracle import connect, rows

import __spark_entry__ as entry

QUERIES, ORACLES = {}, {}
for _module in entry.MODULES:
    QUERIES |= importlib.import_module(_module).QUERIES
    ORACLES |= importlib.import_module(_module).ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
