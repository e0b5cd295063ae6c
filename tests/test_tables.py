"""SQL table functions equal the Python analyses."""

from __future__ import annotations

import pytest

from meridian import operators as op
from meridian.functions.tables import register_functions
from meridian.sources.star import Star
from tests.random_star import build


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    build(str(d), 12)
    s = Star.from_testdata(spark, str(d))
    names = register_functions(s, "m_")
    assert len(names) == 8
    return s


@pytest.mark.parametrize("region", [None, "ASIA", "O'Hare", "nowhere"])
def test_table_functions_equal_the_analyses(spark, star, region):
    def call(name, *given):
        marks = [f"{k} => :{k}" for k in ("in_region",) if region is not None] + list(given)
        return rows(spark.sql(f"SELECT * FROM m_{name}({', '.join(marks)})", args={"in_region": region} if region is not None else None))

    for name in ("sales_by_region", "seasonality", "lifetime_value", "churn", "order_gaps", "rep_contribution"):
        assert call(name) == rows(getattr(op, name)(star, region)), name
    assert call("account_roster", "rep_prefix => 'NATION_1'") == rows(op.account_roster(star, region, rep_prefix="NATION_1"))
    assert call("account_roster", "rep_contains => '2'") == rows(op.account_roster(star, region, rep_contains="2"))
    want = op.sales_by_month(star, region, years=range(1995, 1999), detail=True)
    assert call("sales_by_month", "first_year => 1995", "last_year => 1998") == rows(
        want.select("year", "month", "total_usd", "avg_order_amt", "total_orders"))


def test_filters_reach_into_a_function(spark, star):
    plan = spark.sql("SELECT total_usd FROM m_sales_by_month(1995, 1996) WHERE month = 2")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "month(" in plan.split("FileScan")[0].rsplit("Filter", 1)[1]  # the month is tested before the sums
    got = spark.sql("SELECT f.account_name FROM m_lifetime_value('ASIA') f JOIN m_order_gaps() g ON f.account_name = g.account_name")
    assert got.columns == ["account_name"]
