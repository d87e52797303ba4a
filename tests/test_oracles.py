"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import pytest
from oracle import assert_same, views

import shelfmark.plans.all  # noqa: F401
from shelfmark.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, sf_dir, con):
    assert_same(registry.runnable(name)(spark, sf_dir).toPandas(), con.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(name, spark, sf_dir):
    assert registry.runnable(name)(spark, sf_dir).count() > 0
