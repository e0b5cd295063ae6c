"""Analyses that keep every row: all ranks, all gaps, and distinct counts at every grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import exprs as E
from meridian.plans.bitmaps import distinct_counts, id_bitmaps
from meridian.plans.ranks import with_dense_rank, with_previous
from meridian.plans.scope import account_dim, accounts_fit, early_scope, scope_region, small
from meridian.plans.skew import split_join
from meridian.plans.states import account_totals
from meridian.sources.star import Star


def account_ranks(star: Star, region: str | None = None) -> DataFrame:
    """Every account (of the scope) with its order count, its spend and the dense rank of each, largest first, in
    the scope; accounts without any spend share the last rank.

    The full ranks of the reference's segmentation, which needs the first ten only (``rank_segments``)."""
    s = scope_region(star, region)
    acc = s.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    per = account_totals(s).select("account_id", "n", F.col("cents").cast("decimal(38,0)").alias("spent"))
    rows = acc.join(per, "account_id", "left").withColumn("total_orders", F.coalesce("n", F.lit(0).cast("long")))
    rows = with_dense_rank(rows, "total_orders", "order_rank", ["account_id"])
    rows = with_dense_rank(rows, "spent", "spend_rank", ["account_id"])
    return rows.select("account_id", "account_name", "total_orders", E.usd("spent").alias("total_spend"),
                       "order_rank", "spend_rank").orderBy("order_rank", "spend_rank", "account_id")


def order_intervals(star: Star, region: str | None = None) -> DataFrame:
    """Every order of an account (of the scope) with the time of the account's order before it (by time, then id) and
    the calendar days between the two; the first has NULL. Orders without a time or a known account are absent.

    The rows behind ``order_gaps``, whose mean has a closed form. A hot account's orders are cut by time."""
    s = scope_region(star, region)
    o = s.orders.select("id", "account_id", "occurred_at")
    ids = s.accounts.select(F.col("id").alias("account_id")).distinct()
    if accounts_fit(s):
        o = o.join(F.broadcast(ids), "account_id", "left_semi")
    else:
        o = split_join(o, ids, "account_id", ["id"], "left_semi")
    found = with_previous(o, "account_id", "occurred_at", "id", "previous_at")
    return found.select("account_id", F.col("id").alias("order_id"), "occurred_at", "previous_at",
                        F.datediff("occurred_at", "previous_at").cast("long").alias("days"))


def channel_reach(star: Star, region: str | None = None) -> DataFrame:
    """Distinct accounts by (region name, channel), by channel, by region and in all, in one pass over the events of
    accounts with a representative in a region: (level, region_name, channel, accounts). ``level`` is 0 for region
    and channel, 1 for a region, 2 for a channel, 3 for all.

    The counts of a coarser level are no sums of the finer ones, since an account uses several channels;
    they come from the union of the accounts' bitmaps. An empty scope gives no rows."""
    s = scope_region(star, region)
    dim = account_dim(s, "inner").select("account_id", "region_name")
    pairs = s.web_events.select("account_id", "channel").distinct()
    pairs = pairs.join(small(s, "accounts", dim), "account_id")
    bitmaps = id_bitmaps(pairs, ["region_name", "channel"], "account_id")
    out = distinct_counts(bitmaps, [["region_name", "channel"], ["region_name"], ["channel"], []], ["region_name", "channel"], "accounts")
    return out.select(F.col("level").cast("long").alias("level"), "region_name", "channel", "accounts")


def active_accounts(star: Star, region: str | None = None) -> DataFrame:
    """Distinct ordering accounts by month, by year and in all: (level, year, month, accounts); ``level`` is 0 for a
    month, 1 for a year, 3 for all. Unscoped every account id of an order counts; orders without a time are in
    the NULL year. An empty scope gives no rows."""
    s = scope_region(star, region)
    if s.order_states is not None:
        o = s.order_states.select("account_id", F.col("order_year").alias("year"), F.col("order_month").alias("month"))
    else:
        o = early_scope(s, s.orders).select("account_id", E.year("occurred_at").alias("year"), E.month("occurred_at").alias("month"))
    o = o.distinct()
    if s.scope is not None:
        ids = s.accounts.select(F.col("id").alias("account_id"))
        o = o.join(small(s, "accounts", ids), "account_id", "left_semi")
    out = distinct_counts(id_bitmaps(o, ["year", "month"], "account_id"), [["year", "month"], ["year"], []], ["year", "month"], "accounts")
    return out.select(F.col("level").cast("long").alias("level"), "year", "month", "accounts")
