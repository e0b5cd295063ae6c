"""Analyses as SQL table functions, for users who ask in SQL.

``register_functions(star)`` makes the star's tables views and defines a temporary function for each analysis here,
with named arguments that may be left out::

    SELECT * FROM sales_by_region(in_region => 'Midwest')
    SELECT account_name FROM lifetime_value() WHERE total_spent > 1000

A function is a query that Spark inlines, so that a filter or a selection of columns around it is pushed into it like
into any view. Facts are summed per account before they meet the accounts, as in the Python analyses, whose
results these equal, row for row; like any query without ORDER BY, they have no order.
"""

from __future__ import annotations

from meridian.functions.exprs import half_up_units
from meridian.sources.star import Star

_CENTS = "sum(CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS DECIMAL(18,0)))"
_MERGED = "sum(CAST({c} AS DECIMAL(28,0)))"


def _usd(c: str) -> str:
    return f"CAST({c} AS DOUBLE) / 100"


def _mean(cents: str, n: str) -> str:
    return f"try_divide({_usd(cents)}, CAST({n} AS DOUBLE))"


def _ratio(num: str, den: str, scale: int = 1) -> str:
    return f"CAST({half_up_units(num, den, 2, scale, 0)} AS DOUBLE) / 100"


def _bodies(at: dict[str, str]) -> dict[str, tuple[str, str, str]]:
    """Name to (arguments, columns, query) over the views ``at`` names."""
    # arguments are named in a function's outer queries only; there the condition of the scope becomes one of the region's scan
    owned = (f"SELECT a.id AS account_id, a.name AS account_name, s.id AS rep_id, s.name AS rep_name, g.name AS region_name "
             f"FROM {at['accounts']} a JOIN {at['sales_reps']} s ON a.sales_rep_id = s.id JOIN {at['region']} g ON s.region_id = g.id")
    where = "(in_region IS NULL OR region_name = in_region)"
    scoped = f"LEFT JOIN (SELECT account_id, region_name FROM ({owned})) USING (account_id)"
    spent = (f"SELECT account_id, count(id) AS n, count(total_amt_usd) AS n_amt, {_CENTS.format(c='total_amt_usd')} AS cents, "
             f"count(occurred_at) AS n_timed, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM {at['orders']} GROUP BY account_id")
    everyone = f"SELECT id AS account_id, name AS account_name, website, primary_poc FROM {at['accounts']}"
    periods = (f"SELECT account_id, CAST(year(occurred_at) AS BIGINT) AS year, CAST(month(occurred_at) AS BIGINT) AS month, "
               f"{_CENTS.format(c='total_amt_usd')} AS cents, count(total_amt_usd) AS n_amt, count(id) AS n FROM {at['orders']}")
    region = "in_region STRING DEFAULT NULL"
    return {
        "account_roster": (
            f"{region}, rep_prefix STRING DEFAULT NULL, rep_contains STRING DEFAULT NULL", "region STRING, rep_name STRING, account_name STRING",
            f"SELECT region_name, rep_name, account_name FROM ({owned}) WHERE {where} AND (rep_prefix IS NULL OR startswith(rep_name, rep_prefix)) "
            "AND (rep_contains IS NULL OR contains(rep_name, rep_contains))"),
        "sales_by_region": (
            region, "region_name STRING, total_sales DOUBLE",
            f"SELECT region_name, {_usd(_MERGED.format(c='cents'))} FROM ({spent}) JOIN ({owned}) USING (account_id) WHERE {where} GROUP BY region_name"),
        "sales_by_month": (
            f"first_year INT, last_year INT, {region}", "year BIGINT, month BIGINT, total_usd DOUBLE, avg_order_amt DOUBLE, total_orders BIGINT",
            f"SELECT year, month, {_usd(_MERGED.format(c='cents'))}, {_mean(_MERGED.format(c='cents'), 'sum(n_amt)')}, sum(n) FROM "
            f"({periods} WHERE occurred_at >= CAST(make_date(first_year, 1, 1) AS TIMESTAMP_NTZ) "
            f"AND occurred_at < CAST(make_date(last_year + 1, 1, 1) AS TIMESTAMP_NTZ) GROUP BY ALL) {scoped} WHERE {where} GROUP BY year, month"),
        "seasonality": (
            region, "month BIGINT, total_sales DOUBLE",
            f"SELECT month, {_usd(_MERGED.format(c='cents'))} FROM ({periods} GROUP BY ALL) {scoped} WHERE {where} GROUP BY month"),
        "lifetime_value": (
            region, "account_id BIGINT, account_name STRING, total_spent DOUBLE, total_orders BIGINT, average_order_amount DOUBLE",
            f"SELECT account_id, account_name, {_usd('cents')}, coalesce(n, 0), {_mean('cents', 'n_amt')} FROM ({everyone}) "
            f"LEFT JOIN ({spent}) USING (account_id) {scoped} WHERE {where}"),
        "churn": (
            region, "active_customers BIGINT, churned_customers BIGINT",
            f"SELECT count(active), count(*) - count(active) FROM (SELECT DISTINCT account_id FROM ({everyone}) {scoped} WHERE account_id IS NOT NULL AND {where}) "
            f"LEFT JOIN (SELECT DISTINCT account_id, 1 AS active FROM {at['orders']}) USING (account_id)"),
        "order_gaps": (
            region, "account_name STRING, website STRING, primary_contact STRING, avg_days_between_orders DOUBLE",
            f"SELECT account_name, website, primary_poc, {_ratio('datediff(last_at, first_at)', 'n_timed - 1')} FROM "
            f"(SELECT * FROM ({spent}) WHERE n_timed >= 2) JOIN ({everyone}) USING (account_id) {scoped} WHERE {where}"),
        "rep_contribution": (
            region, "region_name STRING, sales_representative STRING, num_orders BIGINT, total_amt_usd DOUBLE, region_total_amt_usd DOUBLE, "
            "contribution_percent_of_region DOUBLE",
            f"SELECT region_name, rep_name, n, {_usd('cents')}, {_usd('total')}, {_ratio('cents', 'total', 100)} FROM ("
            f"SELECT *, {_MERGED.format(c='cents')} OVER (PARTITION BY region_name) AS total FROM (SELECT region_name, rep_name, sum(n) AS n, "
            f"{_MERGED.format(c='cents')} AS cents FROM ({spent}) JOIN ({owned}) USING (account_id) GROUP BY region_name, rep_name)) WHERE {where}"),
    }


def register_functions(star: Star, prefix: str = "") -> list[str]:
    """Define the table functions (named ``prefix`` and the analysis' name) over the star's tables, which become temporary
    views named ``prefix`` and the table's name. Returns the functions' names."""
    spark = star.orders.sparkSession
    star.register_views(prefix)
    names = []
    for name, (arguments, columns, query) in _bodies({t: f"{prefix}{t}" for t in ("region", "sales_reps", "accounts", "orders")}).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE ({columns}) RETURN {query}")
        names.append(prefix + name)
    return names
