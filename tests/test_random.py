"""Differential test: every registered query against its oracle on seeded random stars
(NULL times, amounts, keys, names and channels; dangling keys; namesakes)."""

from __future__ import annotations

import pytest

from meridian import registry
from tests.compare import compare, duck
from tests.random_star import build

SEEDS = [23]


NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module", params=SEEDS)
def random_dir(request, tmp_path_factory):
    d = tmp_path_factory.mktemp(f"random{request.param}")
    build(str(d), request.param)
    return str(d), duck(str(d))


@pytest.mark.parametrize("name", NAMES)
def test_random_star_matches_oracle(spark, random_dir, name):
    path, con = random_dir
    problems = compare(registry.queries()[name](spark, path), con, registry.oracle_sql()[name])
    assert not problems, problems


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    """One account holds a third of the orders and events; no size bound is proven, and AQE's
    skew thresholds are lowered so that its skew handling really splits partitions."""
    d = tmp_path_factory.mktemp("hot")
    build(str(d), 5, hot=True)
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield str(d), duck(str(d))
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", NAMES)
def test_hot_account_matches_oracle(spark, hot_dir, name):
    from meridian.sources.star import Star
    path, con = hot_dir
    fn, sql = registry.ENTRIES[name]
    problems = compare(fn(Star.from_testdata(spark, path, broadcast_rows=0)), con, sql)
    assert not problems, problems


def test_matrix_keeps_every_channel(spark, random_dir):
    """Channels that no list names, and events without one, are counted too."""
    from meridian import operators as op
    from meridian.sources.star import Star
    star = Star.from_testdata(spark, random_dir[0])
    totals = {}
    for r in op.rep_channel_counts(star).collect():
        totals[r["sales_rep_name"]] = totals.get(r["sales_rep_name"], 0) + r["number_of_occurrences"]
    for channels in (None, [], ["view"]):
        wide = op.rep_channel_matrix(star, channels=channels).collect()
        assert {r[0]: sum(r[1:]) for r in wide} == totals


def test_repeated_accounts_count_once_under_either_plan(spark, random_dir):
    from meridian import operators as op
    from meridian.sources.star import Star
    star = Star.from_testdata(spark, random_dir[0])
    twice = star.narrowed(accounts=star.accounts.unionAll(star.accounts))
    shuffled = star.narrowed(accounts=star.accounts.unionAll(star.accounts), broadcast_rows=0)
    shuffled._fits.clear()
    for fn in (op.channel_effectiveness, op.region_channel, op.rep_acquisition):
        once, both, big = (sorted(map(tuple, fn(s).collect()), key=repr) for s in (star, twice, shuffled))
        assert both == big
        if fn is op.rep_acquisition:
            assert both == once
        else:
            assert [r[-1] for r in both] == [r[-1] for r in once] or fn is op.region_channel


def test_money_beyond_a_long(spark):
    from meridian import operators as op
    from meridian.sources.star import Star
    q = spark.sql
    big = Star.from_frames(
        q("select 1 id, 'R' name"), q("select 1 id, 'S' name, 1 region_id"),
        q("select id, concat('A', id) name, '' website, '' primary_poc, 1 sales_rep_id from range(3)"),
        q("select id, id % 3 account_id, timestamp_ntz'2015-01-01 00:00:00' occurred_at, 0L standard_qty, 0L gloss_qty, "
          "0L poster_qty, 0L total, cast(0 as decimal(18,2)) standard_amt_usd, cast(0 as decimal(18,2)) gloss_amt_usd, "
          "cast(0 as decimal(18,2)) poster_amt_usd, cast(5000000000000000 as decimal(18,2)) total_amt_usd from range(60)"),
        q("select 1L id, 1L account_id, 'c' channel"))
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            assert op.sales_by_region(big).collect()[0][1] == 3e17
            assert op.headline_sales(big).collect()[0][0] == 3e17
            assert op.sales_by_year(big).collect()[0][1] == 3e17
            assert op.rep_contribution(big).collect()[0][4:] == (3e17, 100.0)
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
