"""Sales over time, region and product.

Every function takes a :class:`~meridian.sources.star.Star` and an optional region name and
returns a lazy DataFrame. Money is summed exactly (integer cents) and leaves as double.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import exprs as E
from meridian.plans.scope import (account_dim, account_ids, accounts_fit, aggregate,
                                  early_scope, rollup, scope_region, small)
from meridian.plans.skew import split_join
from meridian.plans.states import (MONTH, REGION, REP, YEAR, YEAR_MONTH, account_totals, period_totals,
                                   territory_totals)
from meridian.sources.star import ORDER_YEAR, PRODUCTS, Star


def _amounts(orders: DataFrame) -> DataFrame:
    return orders.select("id", "account_id", "occurred_at", E.cents("total_amt_usd").alias("amt"))


def _region_totals(s: Star) -> DataFrame:
    """(region_name, total cents, number of amounts) over orders whose account has a rep in a
    region."""
    if s.order_states is not None:
        return territory_totals(s).filter(F.col("level") == REGION).select("region_name", F.col("cents").alias("total"), "n_amt")
    dim = account_dim(s, "inner").select("account_id", "region_name")
    return rollup(s, _amounts(s.orders), dim, ["region_name"],
                  {"total": ("sum", "amt"), "n_amt": ("count", "amt")})


def sales_by_region(star: Star, region: str | None = None) -> DataFrame:
    """Total order USD per region name, largest first."""
    s = scope_region(star, region)
    return (_region_totals(s)
            .select("region_name", E.usd("total").alias("total_sales"))
            .orderBy(F.col("total_sales").desc_nulls_last(), "region_name"))


def headline_sales(star: Star, region: str | None = None) -> DataFrame:
    """One row: total sales of the scope, rounded half-even to whole USD (NULL if empty)."""
    s = scope_region(star, region)
    return _region_totals(s).agg(F.bround(E.usd(E.merge_cents("total")), 0).alias("total_sales"))


def mean_order_by_region(star: Star, region: str | None = None,
                         formatted: bool = False) -> DataFrame:
    """Mean order USD per region name, largest first; ``formatted`` adds '$1,234.56' text."""
    s = scope_region(star, region)
    out = _region_totals(s).select("region_name",
                                   E.mean("total", "n_amt").alias("avg_order_size"))
    if formatted:
        out = out.withColumn("avg_order_size_text",
                             F.concat(F.lit("$"), F.format_number("avg_order_size", 2)))
    return out.orderBy(F.col("avg_order_size").desc_nulls_last(), "region_name")


def _by_period(star: Star, region: str | None, keys: dict, measures: dict,
               where=None, years: Iterable[int] | None = None) -> DataFrame:
    """Orders aggregated per calendar period ``keys`` (name -> expression). Unscoped it counts
    every order, also those without an account; scoped, it rolls up through the scope's
    accounts (map-side when they are proven few, else pre-aggregated per account first). ``years``
    limits it to these. A star with states has the periods from one pass over them."""
    s = scope_region(star, region)
    level = {("year", "month"): YEAR_MONTH, ("year",): YEAR, ("month",): MONTH}.get(tuple(keys))
    if s.order_states is not None and level is not None and where is None:
        per = period_totals(s).filter(F.col("level") == level)
        if years is not None:
            per = per.filter(F.col("year").isin(list(years)))
        names = {"total": "cents", "n_amt": "n_amt", "n": "n", "mx": "max_cents"}
        return per.select(*keys, *[F.col(names[m]).alias(m) for m in measures])
    if years is not None:
        where = lambda o: E.in_years(o, "occurred_at", years)
    o = s.orders if where is None else s.orders.filter(where(s.orders))
    o = _amounts(o).select("*", *[c.alias(k) for k, c in keys.items()])
    if s.scope is None:
        return aggregate(o, list(keys), measures)
    return rollup(s, o, account_ids(s), list(keys), measures)


def sales_by_year(star: Star, region: str | None = None) -> DataFrame:
    """Order USD per calendar year, smallest first. Unscoped it counts every order."""
    return (_by_period(star, region, {"year": E.year("occurred_at")}, {"total": ("sum", "amt")})
            .select("year", E.usd("total").alias("total_usd"))
            .orderBy(F.col("total_usd").asc_nulls_last(), "year"))


def sales_year_extremes(star: Star, region: str | None = None) -> DataFrame:
    """Two rows, kind 'lowest' and 'highest': the year with the least / most order USD.
    Ties go to the earlier year; an empty scope gives no rows."""
    yearly = sales_by_year(star, region).filter(F.col("total_usd").isNotNull())
    lo = F.min(F.struct("total_usd", "year"))
    hi = F.max(F.struct(F.col("total_usd"), (-F.col("year")).alias("neg_year")))
    both = yearly.agg(lo.alias("lo"), hi.alias("hi")).filter(F.col("lo").isNotNull())
    return both.select(F.inline(F.array(
        F.struct(F.lit("lowest").alias("kind"), F.col("lo.year").alias("year"),
                 F.col("lo.total_usd").alias("total_usd")),
        F.struct(F.lit("highest").alias("kind"), (-F.col("hi.neg_year")).alias("year"),
                 F.col("hi.total_usd").alias("total_usd")))))


def sales_by_month(star: Star, region: str | None = None,
                   years: Iterable[int] = (2013, 2017), detail: bool = False) -> DataFrame:
    """Order USD per (year, month) for the given years; ``detail`` adds mean, count, max and
    a 'yyyy-mm' label. The year filter is a range predicate, so Parquet can skip row groups."""
    measures = {"total": ("sum", "amt"), "n_amt": ("count", "amt"), "n": ("count", "id"),
                "mx": ("max", "amt")}
    per = _by_period(star, region, {"year": E.year("occurred_at"),
                                    "month": E.month("occurred_at")}, measures, years=list(years))
    cols = ["year", "month", E.usd("total").alias("total_usd")]
    if detail:
        cols += [E.mean("total", "n_amt").alias("avg_order_amt"), F.col("n").alias("total_orders"),
                 E.usd("mx").alias("max_order_amt"),
                 F.format_string("%d-%02d", "year", "month").alias("year_month")]
    return per.select(*cols).orderBy("year", "month")


def sales_on_day(star: Star, region: str | None = None, month: int = 1,
                 day: int = 1, years: Iterable[int] | None = None) -> DataFrame:
    """Order USD per year on one calendar day (default 1 January), smallest first. With ``years`` the day is
    one half-open range a year, which partitions and row groups can be pruned by."""
    keys = {"year": E.year("occurred_at"), "month": E.month("occurred_at"),
            "day": E.day("occurred_at")}
    per = _by_period(star, region, keys, {"total": ("sum", "amt")},
                     where=lambda o: E.on_day(o, "occurred_at", month, day, years))
    return (per.select("year", "month", "day", E.usd("total").alias("total_usd"))
            .orderBy(F.col("total_usd").asc_nulls_last(), "year"))


def seasonality(star: Star, region: str | None = None, names: bool = False) -> DataFrame:
    """Order USD per calendar month over all years; ``names`` adds the English month name.
    Unscoped it counts every order, also those without an account."""
    out = (_by_period(star, region, {"month": E.month("occurred_at")}, {"total": ("sum", "amt")})
           .select("month", E.usd("total").alias("total_sales")))
    if names:
        out = out.withColumn("month_name", E.month_name("month"))
    return out.orderBy(F.col("month").asc_nulls_last())


def best_month(star: Star, account: str, measure: str = "gloss_amt_usd",
               region: str | None = None) -> DataFrame:
    """The (year, month) with the highest total of ``measure`` for accounts named ``account``.
    One row; ties go to the earlier month."""
    s = scope_region(star, region)
    named = s.narrowed(accounts=s.accounts.filter(F.col("name") == F.lit(account)))
    acc = named.accounts.select(F.col("id").alias("account_id"),
                                F.col("name").alias("account_name"))
    few = small(named, "accounts", acc.select("account_id"))  # a few accounts: map-side join
    o = s.details(lambda orders: orders.join(few, "account_id", "left_semi"))
    o = o.select("account_id", "occurred_at", E.cents(measure).alias("amt"))
    j = o.join(small(named, "accounts", acc), "account_id")
    out_col = measure.replace("_amt_usd", "") + "_total_usd"
    return (j.groupBy("account_name", E.year("occurred_at").alias("year"),
                      E.month("occurred_at").alias("month"))
            .agg(E.usd(E.sum_cents("amt")).alias(out_col))
            .orderBy(F.col(out_col).desc_nulls_last(), "year", "month")
            .limit(1))


def rep_contribution(star: Star, region: str | None = None) -> DataFrame:
    """Per (region, rep name): orders, USD, the region's USD and the rep's share in percent
    (2 dp, exact). Shares of a region are the same whether or not the region is scoped."""
    s = scope_region(star, region)
    if s.order_states is not None:
        per_rep = territory_totals(s).filter(F.col("level") == REP).select(
            "region_name", "rep_name", F.col("n").alias("num_orders"), F.col("cents").alias("total"))
    else:
        dim = account_dim(s, "inner").select("account_id", "region_name", "rep_name")
        per_rep = rollup(s, _amounts(s.orders), dim, ["region_name", "rep_name"],
                         {"num_orders": ("count", "id"), "total": ("sum", "amt")})
    region_total = E.merge_cents("total").over(Window.partitionBy("region_name"))
    return (per_rep.withColumn("region_total", region_total)
            .select("region_name", F.col("rep_name").alias("sales_representative"),
                    "num_orders", E.usd("total").alias("total_amt_usd"),
                    E.usd("region_total").alias("region_total_amt_usd"),
                    E.percent("total", "region_total")
                    .alias("contribution_percent_of_region"))
            .orderBy(F.col("region_name").asc_nulls_last(),
                     F.col("contribution_percent_of_region").desc_nulls_last(),
                     "sales_representative"))


def _with_names(star: Star, per_account: DataFrame) -> DataFrame:
    names = star.accounts.select(F.col("id").alias("account_id"),
                                 F.col("name").alias("account_name"))
    if accounts_fit(star):
        names = F.broadcast(names)
    return per_account.join(names, "account_id")


def quarterly_change(star: Star, region: str | None = None) -> DataFrame:
    """Per account and (year, quarter): change of each product quantity against the account's
    previous quarter *with orders* (gaps are not filled); 0 for its first quarter."""
    s = scope_region(star, region)
    q = account_totals(s, ORDER_YEAR, "order_quarter", products=True)  # the join with the scope's names restricts it
    q = q.select("account_id", ORDER_YEAR, "order_quarter", *[F.col(f"{p}_qty").alias(p) for p in PRODUCTS])
    # an order without a time forms a NULL period, placed first
    w = Window.partitionBy("account_id").orderBy(F.col("order_year").asc_nulls_first(),
                                                 F.col("order_quarter").asc_nulls_first())
    q = q.select("account_id", "order_year", "order_quarter", *[
        F.when(F.lag(p).over(w).isNull(), F.lit(0).cast("long"))
        .otherwise(F.col(p) - F.lag(p).over(w)).alias(f"quarterly_{p}_qty_growth")
        for p in PRODUCTS])
    return (_with_names(s, q)
            .select("account_name", "order_year", "order_quarter",
                    *[f"quarterly_{p}_qty_growth" for p in PRODUCTS], "account_id")
            .orderBy("order_year", "order_quarter", "account_name", "account_id")
            .drop("account_id"))


def yearly_change(star: Star, region: str | None = None) -> DataFrame:
    """Per account and year: order USD and its change against the account's previous year
    *with orders*; 0 for its first year."""
    s = scope_region(star, region)
    y = account_totals(s, ORDER_YEAR).select("account_id", ORDER_YEAR, F.col("cents").alias("total"))
    w = Window.partitionBy("account_id").orderBy(F.col("order_year").asc_nulls_first())
    prev = F.lag("total").over(w)
    y = y.select("account_id", "order_year", E.usd("total").alias("total_order_amount"),
                 F.when(prev.isNull(), F.lit(0.0))
                 .otherwise(E.usd(F.col("total") - prev))
                 .alias("year_over_year_order_amount_change"))
    # many rows tie on (year, change) -- every account's first year has change 0 -- so the
    # account id completes the sort key and the range partitioning splits the ties
    return (_with_names(s, y)
            .select("account_name", "order_year", "total_order_amount",
                    "year_over_year_order_amount_change", "account_id")
            .orderBy(F.col("order_year").asc_nulls_last(),
                     F.col("year_over_year_order_amount_change").desc_nulls_last(),
                     "account_name", "account_id")
            .drop("account_id"))


def _scoped_details(s: Star) -> DataFrame:
    """Orders with their product split; of the scope's accounts only, where that is a map-side filter."""
    if s.scope is None or not s.fits("accounts"):
        return s.detailed_orders
    return s.details(lambda orders: early_scope(s, orders))


def unit_prices(star: Star, region: str | None = None, min_standard: float = 100,
                min_poster: float | None = None, with_region: bool = True) -> DataFrame:
    """``total_amt_usd / (total + 0.01)`` of orders with standard_qty > ``min_standard``
    (and poster_qty > ``min_poster`` when given, then dearest first)."""
    s = scope_region(star, region)
    o = _scoped_details(s).filter(F.col("standard_qty") > min_standard)
    if min_poster is not None:
        o = o.filter(F.col("poster_qty") > min_poster)
    o = o.select("id", "account_id", (F.col("total_amt_usd").cast("double")
                                / (F.col("total").cast("double") + F.lit(0.01)))
                 .alias("unit_price"))
    dim = account_dim(s, "inner").select("account_id", "account_name",
                                         F.col("region_name").alias("region"))
    # an order is a row of the result, so a hot account's orders meet the accounts in many tasks
    j = o.join(F.broadcast(dim), "account_id") if accounts_fit(s) else split_join(o, dim, "account_id", ["id"])
    cols = (["region"] if with_region else []) + ["account_name", "unit_price"]
    if min_poster is None:
        return j.select(*cols)
    return (j.select(*cols, "id").orderBy(F.col("unit_price").desc_nulls_last(), "id")
            .drop("id"))


def mean_product_amounts(star: Star, region: str | None = None) -> DataFrame:
    """Mean standard / gloss / poster USD per account *name* (namesakes merge; accounts
    without orders are absent)."""
    s = scope_region(star, region)
    if s.order_states is not None:
        o = account_totals(s, products=True).select("account_id", *[F.col(f"{p}_{k}") for p in PRODUCTS for k in ("cents", "n")])
        fields = {p: (f"{p}_cents", f"{p}_n") for p in PRODUCTS}
    else:
        o = _scoped_details(s).select("account_id", *[E.cents(f"{p}_amt_usd").alias(p) for p in PRODUCTS])
        fields = {p: (p, p) for p in PRODUCTS}
    dim = s.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    measures = {}
    for p in PRODUCTS:
        measures[f"{p}_sum"] = ("sum", fields[p][0])
        measures[f"{p}_n"] = ("count", fields[p][1])
    per_name = rollup(s, o, dim, ["account_name"], measures, states=s.order_states is not None)
    return per_name.select("account_name", *[E.mean(f"{p}_sum", f"{p}_n")
                                             .alias(f"avg_{p}_amt_usd") for p in PRODUCTS])
