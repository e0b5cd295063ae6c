"""Invariants between analyses on the sf0.01 testdata."""

from __future__ import annotations

import pytest

from meridian import operators as op
from meridian.sources.star import Star

SF_DIR = "/root/testdata/sf0.01"
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@pytest.fixture(scope="module")
def star(spark):
    return Star.from_testdata(spark, SF_DIR)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_contribution_shares_sum_to_100(star):
    shares = {}
    for r in rows(op.rep_contribution(star)):
        shares.setdefault(r["region_name"], []).append(r["contribution_percent_of_region"])
    for region, s in shares.items():
        assert abs(sum(s) - 100) <= 0.005 * len(s) + 1e-9, region


def test_active_plus_churned_is_all_accounts(star):
    c = rows(op.churn(star))[0]
    assert c["active_customers"] + c["churned_customers"] == star.accounts.count()


def test_retained_at_most_total(star):
    for r in rows(op.cohort_retention(star)):
        assert 0 <= r["retained_customers"] <= r["total_customers"] == r["new_customers"]


def test_region_sales_add_up_to_yearly_sales(star):
    by_region = sum(r["total_sales"] for r in rows(op.sales_by_region(star)))
    by_year = sum(r["total_usd"] for r in rows(op.sales_by_year(star)))
    assert by_region == pytest.approx(by_year, rel=1e-12)
    head = rows(op.headline_sales(star))[0]["total_sales"]
    assert abs(head - by_region) <= 0.5


@pytest.mark.parametrize("fn,key", [(op.sales_by_region, "region_name"),
                                    (op.mean_order_by_region, "region_name"),
                                    (op.region_channel, "region_name"),
                                    (op.rep_contribution, "region_name")])
def test_scoping_commutes_with_filtering(star, fn, key):
    everything = rows(fn(star))
    for region in REGIONS:
        scoped = rows(fn(star, region))
        assert sorted(map(repr, scoped)) == sorted(
            repr(r) for r in everything if r[key] == region)


def test_matrix_rows_equal_counts(star):
    from meridian.registry import CHANNELS
    counts = {}
    for r in rows(op.rep_channel_counts(star)):
        counts[r["sales_rep_name"]] = counts.get(r["sales_rep_name"], 0) + r["number_of_occurrences"]
    for r in rows(op.rep_channel_matrix(star, channels=CHANNELS)):
        assert sum(r[c] for c in CHANNELS) == counts[r["sales_rep_name"]]


def test_segments_partition_the_accounts(star):
    n = star.accounts.count()
    assert sum(r["num_accounts"] for r in rows(op.volume_segments(star))) == n
    assert sum(r["num_accounts"] for r in rows(op.volume_value_segments(star))) == n
    assert len(rows(op.rank_segments(star))) == n
    assert len(rows(op.lifetime_value(star))) == n
