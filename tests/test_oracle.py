"""Every registered query equals its DuckDB oracle on the sf0.01 testdata, with the
broadcast plans (dimensions proven small) and with the shuffle plans (no bound proven)."""

import os

import pytest

from meridian import registry
from meridian.sources.star import Star
from tests.compare import compare, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF_DIR)
    problems = compare(df, con, registry.oracle_sql()[name])
    assert not problems, problems


@pytest.fixture(scope="module")
def unbounded_star(spark):
    """broadcast_rows=0: no table is proven small, so every join is a shuffle join."""
    return Star.from_testdata(spark, SF_DIR, broadcast_rows=0)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_shuffle_plans_match_oracle(spark, con, unbounded_star, name):
    fn, sql = registry.ENTRIES[name]
    problems = compare(fn(unbounded_star), con, sql)
    assert not problems, problems
