"""Account-level analyses: rosters, lifetime value, acquisition, churn, gaps, growth, top means.

Facts are always aggregated per account first (partial + final hash aggregate) and only the
per-account rows meet the accounts table, so the join is 1:1 and a hot account costs nothing
more than its map-side partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import exprs as E
from meridian.plans.scope import accounts_fit, early_scope, rep_dim, scope_region, small
from meridian.plans.states import account_totals
from meridian.sources.star import ORDER_YEAR, Star


def region_catalog(star: Star) -> DataFrame:
    """Distinct region names in first-seen (lowest id) order; the caller adds an 'all' choice."""
    return (star.region.groupBy("name").agg(F.min("id").alias("_first"))
            .orderBy(F.col("_first").asc_nulls_last(), "name").select("name"))


def account_roster(star: Star, region: str | None = None, rep_prefix: str | None = None,
                   rep_contains: str | None = None, ignore_case: bool = False) -> DataFrame:
    """(region, rep_name, account_name) of accounts whose rep sits in a region, optionally for
    reps whose name starts with / contains a pattern; by account name."""
    s = scope_region(star, region)
    reps = rep_dim(s, "inner").filter(E.like("rep_name", rep_prefix, rep_contains, ignore_case))
    acc = s.accounts.select("id", F.col("sales_rep_id").alias("rep_id"),
                            F.col("name").alias("account_name"))
    return (acc.join(small(s, "sales_reps", reps), "rep_id")
            .select(F.col("region_name").alias("region"), "rep_name", "account_name", "id")
            .orderBy(F.col("account_name").asc_nulls_last(), "id")  # id splits namesakes
            .drop("id"))


def accounts_per_rep(star: Star, region: str | None = None) -> DataFrame:
    """Accounts per rep *name* (namesakes merge). Accounts are counted per rep id first, so
    only one row per rep crosses the shuffle."""
    s = scope_region(star, region)
    per_rep = s.accounts.groupBy(F.col("sales_rep_id").alias("rep_id")).agg(
        F.count(F.lit(1)).alias("n"))
    reps = rep_dim(s, "inner")
    return (per_rep.join(small(s, "sales_reps", reps), "rep_id")
            .groupBy("rep_name").agg(F.sum("n").alias("account_count"))
            .orderBy("rep_name"))


def lifetime_value(star: Star, region: str | None = None, marker: bool = False) -> DataFrame:
    """Every account (of the scope) with total spent, number of orders and mean order;
    accounts without orders get 0 orders and NULL amounts. ``marker`` adds marker_size =
    mean order, or 1 where there is none (the metric itself stays NULL)."""
    s = scope_region(star, region)
    per = account_totals(s)  # the left join below restricts it to the scope
    acc = s.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    out = acc.join(per, "account_id", "left").select(
        "account_id", "account_name", E.usd("cents").alias("total_spent"),
        F.coalesce("n", F.lit(0)).alias("total_orders"),
        E.mean("cents", "n_amt").alias("average_order_amount"))
    if marker:
        out = out.withColumn("marker_size", F.coalesce("average_order_amount", F.lit(1.0)))
    return out.orderBy(F.col("total_spent").desc_nulls_last(), "account_id")


def rep_acquisition(star: Star, region: str | None = None) -> DataFrame:
    """Per rep name: accounts held and the year of their earliest order. Reps without
    accounts stay, with 0 and NULL."""
    s = scope_region(star, region)
    first = account_totals(s).select("account_id", F.col("first_at").alias("first_ts"))
    acc = s.accounts.select(F.col("id").alias("account_id"), F.col("sales_rep_id").alias("rep_id"))
    held = acc.join(first, "account_id", "left")
    reps = s.sales_reps.select(F.col("id").alias("rep_id"), F.col("name").alias("rep_name"))
    # an account counts once for a rep name, however often it is listed
    per = (reps.join(held, "rep_id", "left").groupBy("rep_name", "account_id")
           .agg(F.min("first_ts").alias("first_ts")))
    return (per.groupBy(F.col("rep_name").alias("sales_representative"))
            .agg(F.count("account_id").alias("new_customers_acquired"),
                 E.year(F.min("first_ts")).alias("first_order_year"))
            .orderBy(F.col("new_customers_acquired").desc(), "sales_representative"))


def churn(star: Star, region: str | None = None) -> DataFrame:
    """One row: accounts that ever ordered (active) and those that never did (churned)."""
    s = scope_region(star, region)
    ids = s.accounts.select(F.col("id").alias("account_id")).filter(
        F.col("account_id").isNotNull()).distinct()
    ordering = account_totals(s).select("account_id", F.lit(1).alias("active"))
    j = ids.join(ordering, "account_id", "left")
    return j.agg(F.count("active").alias("active_customers"),
                 (F.count(F.lit(1)) - F.count("active")).alias("churned_customers"))


def order_gaps(star: Star, region: str | None = None) -> DataFrame:
    """Mean calendar days between consecutive orders of an account (2 dp, exact), for
    accounts with two or more orders.

    Consecutive gaps telescope: their sum is last date - first date, so the mean is
    datediff(max, min) / (n - 1) and needs only a hash aggregate, no sort and no window."""
    s = scope_region(star, region)
    per = (account_totals(s).filter(F.col("n_timed") >= 2)
           .select("account_id", E.half_up_ratio("datediff(last_at, first_at)", "n_timed - 1", dp=2)
                   .alias("avg_days_between_orders")))
    # one row an account on both sides; the texts are as long as they are, so no bound on rows bounds them
    acc = s.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"),
                            "website", F.col("primary_poc").alias("primary_contact"))
    return (per.join(acc, "account_id")
            .select("account_name", "website", "primary_contact", "avg_days_between_orders",
                    "account_id")
            .orderBy(F.col("avg_days_between_orders").desc_nulls_last(), "account_name",
                     "account_id")
            .drop("account_id"))


# Growth labels.
HIGH_GROWTH, LOW_GROWTH = "High Growth", "Low Growth"


def high_growth(star: Star, region: str | None = None, per_year: float = 10) -> DataFrame:
    """Accounts active in more than one year with more than ``per_year`` orders per active
    year, most orders first. Orders are counted as distinct ids, unless the star knows these to be unique."""
    s = scope_region(star, region)
    if s.order_states is not None and s.unique_orders:
        rows, orders = s.order_states, F.sum("n")
        amounts, cents = F.sum("n_amt"), E.merge_cents("cents")
    else:
        rows = early_scope(s, s.orders).drop(ORDER_YEAR).withColumn(ORDER_YEAR, E.year("occurred_at"))
        # ids that need no comparing stay in their tasks: only counts are shuffled
        orders = F.count("id") if s.unique_orders else F.count_distinct("id")
        amounts, cents = F.count("total_amt_usd"), E.money_sum("total_amt_usd")
    per = rows.groupBy("account_id").agg(  # the set of years is bounded by the time span
        F.min(ORDER_YEAR).alias("first_order_year"), F.max(ORDER_YEAR).alias("last_order_year"),
        orders.alias("total_orders"), F.size(F.collect_set(ORDER_YEAR)).cast("long").alias("order_years_count"),
        E.mean(cents, amounts).alias("avg_order_amt_usd"))
    growth = E.label_by_cuts([(
        (F.col("order_years_count") > 1)
        & (F.col("total_orders") / F.col("order_years_count") > per_year), HIGH_GROWTH)],
        LOW_GROWTH)
    per = per.withColumn("growth_category", growth).filter(F.col("growth_category") == HIGH_GROWTH)
    acc = s.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    return (per.join(F.broadcast(acc) if accounts_fit(s) else acc, "account_id")
            .select("account_name", "first_order_year", "last_order_year", "total_orders",
                    "order_years_count", "avg_order_amt_usd", "growth_category", "account_id")
            .orderBy(F.col("total_orders").desc_nulls_last(), "account_name", "account_id")
            .drop("account_id"))


def top_mean_accounts(star: Star, region: str | None = None) -> DataFrame:
    """Account(s) with the highest mean order, ties kept.

    The maximum is a global aggregate (each task sends one partial maximum), exactly one
    row, broadcast and equi-joined back to the per-account means: tied accounts, however
    many, stay spread over the tasks. The mean is computed from an exact cents sum, so the
    two uses of it agree bit for bit."""
    s = scope_region(star, region)
    per = account_totals(s, restrict=True).select("account_id", E.mean("cents", "n_amt").alias("avg_order_amount"))
    best = per.agg(F.max("avg_order_amount").alias("avg_order_amount"))  # one row
    top = per.join(F.broadcast(best), "avg_order_amount")
    # The maximum includes orders without an account, as the reference's does. A plain
    # equi-join to the accounts would make Spark push "account_id IS NOT NULL" into this
    # branch only, and the two per-account aggregates would no longer be one reusable
    # exchange; a null-safe join to the non-NULL ids means the same and keeps them equal.
    acc = s.accounts.select(F.col("id").alias("_aid"), F.col("name").alias("account_name")
                            ).filter(F.col("_aid").isNotNull())
    acc = small(s, "accounts", acc)
    return (top.join(acc, top["account_id"].eqNullSafe(acc["_aid"]))
            .select("account_name", "avg_order_amount", "account_id")
            .orderBy(F.col("avg_order_amount").desc(), "account_name", "account_id")
            .drop("account_id"))
