"""Plan shape: what must hold for the analyses to scale, read from the physical plans."""

from __future__ import annotations

import re

import pytest

from meridian import operators as op
from meridian.sources.star import Star

SF_DIR = "/root/testdata/sf0.01"


def executed_plan(df) -> str:
    """Final adaptive plan: only the DataFrame's own execution shows it (results are small)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return Star.from_testdata(spark, SF_DIR)


@pytest.fixture(scope="module")
def big_star(spark):
    return Star.from_testdata(spark, SF_DIR, broadcast_rows=0)


def test_rank_segments_has_no_global_window_and_scans_orders_once(star):
    p = executed_plan(op.rank_segments(star))
    assert "SinglePartition" not in p
    assert "TakeOrderedAndProject" in p  # a task sends at most as many values as there are ranks
    assert "ReusedExchange" in p


def test_year_filter_reaches_parquet(star):
    p = plan(op.sales_by_month(star, years=(1995, 2001)))
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p


def test_top_mean_keeps_ties_distributed(star):
    p = executed_plan(op.top_mean_accounts(star))
    assert "Window" not in p  # no single-task ranking; a one-row maximum is broadcast instead
    assert "BroadcastHashJoin" in p
    assert "ReusedExchange" in p  # the maximum and the join read one per-account exchange


def test_region_scope_reaches_region_scan(star):
    p = plan(op.sales_by_region(star, "ASIA"))
    assert "EqualTo(r_name,ASIA)" in p


def test_small_dimensions_are_broadcast(star):
    p = plan(op.sales_by_region(star))
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p


def test_without_a_size_bound_nothing_is_hinted(big_star, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(op.region_channel(big_star))
        assert "BroadcastHashJoin" not in p
        # facts are aggregated per account before they meet the accounts
        agg_then_join = p.index("SortMergeJoin") < p.rindex("HashAggregate")
        assert agg_then_join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_order_gaps_needs_no_sort(star):
    p = plan(op.order_gaps(star).drop("avg_days_between_orders"))
    assert "Window" not in p


def test_scope_and_account_meet_the_orders_before_line_items_are_summed(star):
    for frame in (op.best_month(star, "Customer#000000055"), op.mean_product_amounts(star, "ASIA"),
                  op.unit_prices(star, "ASIA")):
        p = plan(frame)
        assert "LeftSemi" in p[p.index("HashAggregate"):], p


def test_day_of_given_years_is_a_range_in_the_scan(star):
    p = plan(op.sales_on_day(star, years=(1995,)))
    pushed = p[p.index("PushedFilters"):]  # long lists of filters are shown cut off
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01" in pushed and "LessThan(o_orderdate,1" in pushed
    assert "month(" not in p[p.index("Filter ("):p.index("PushedFilters")]


def test_subset_of_a_big_table_is_counted_again(spark):
    """Accounts too big to broadcast, but one account name (or one region's accounts) is
    small: the subset is counted on its own and joined map-side, orders are not shuffled."""
    star = Star.from_testdata(spark, SF_DIR)
    star._fits.update(region=True, sales_reps=True, accounts=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(op.best_month(star, "Customer#000000055"))
        assert "BroadcastHashJoin" in p
        p = plan(op.sales_by_year(star, "ASIA"))
        assert "SortMergeJoin" not in p and "BroadcastHashJoin" in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Queries whose result is one global aggregate row: their last step is a single-partition
# exchange of one partial row per task, which is bounded.
ONE_ROW = {"headline_sales", "headline_sales_scoped", "churn", "churn_scoped",
           "sales_year_extremes", "sales_year_extremes_scoped", "top_mean_accounts",
           "top_mean_accounts_scoped"}


# Queries that number ranges of values: what is gathered is a count a range (see test_sequences).
RANGES = {"account_ranks", "account_ranks_scoped"}


def without_subqueries(plan: str) -> str:
    """The plan without its scalar subqueries: the scope's filter, one value of bounded size."""
    lines, depth = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :"))
        if depth is not None and at > depth:
            continue
        depth = at if re.match(r"[ :]*[+:]- (Subquery|ReusedSubquery) ", line) else None
        if depth is None:
            lines.append(line)
    return "\n".join(lines)


@pytest.fixture(scope="module")
def cluster_star(spark):
    """The 100 TB situation: region and reps proven small, accounts too big to broadcast."""
    star = Star.from_testdata(spark, SF_DIR)
    star._fits.update(region=True, sales_reps=True, accounts=False)
    return star


def test_every_query_plans_for_scale(spark, cluster_star):
    from meridian import registry
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, (fn, _) in registry.ENTRIES.items():
            p = without_subqueries(plan(fn(cluster_star)))
            assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
            if name in RANGES:
                continue
            if name not in ONE_ROW:
                assert "SinglePartition" not in p, name
            # every window is partitioned (an unpartitioned one prints an empty key list)
            assert not re.search(r"Window \[.*\], \[\], \[", p), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
