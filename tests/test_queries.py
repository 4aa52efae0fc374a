"""Every query of the catalogue runs; those with SQL agree with it."""

from __future__ import annotations

import pytest

from lumen import catalogue

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, sf_dir, con, name):
    same(catalogue.queries()[name](spark, sf_dir), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"train_leaderboard"}))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
