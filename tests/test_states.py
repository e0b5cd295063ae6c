"""States by account and month: the analyses served from them, the one-pass dashboard, the maintained roll-up."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from meridian import operators as op
from meridian import registry
from meridian.functions import exprs as E
from meridian.operators.dashboard import datasets
from meridian.plans import states
from meridian.plans.scope import scope_region
from meridian.sources.star import Star
from tests.random_star import build

# Analyses that can be served from states; the others have a row an order, or a day.
SERVED = ["sales_by_region", "headline_sales", "mean_order_by_region", "rep_contribution", "sales_by_year", "sales_year_extremes",
          "sales_by_month", "seasonality", "lifetime_value", "rep_acquisition", "churn", "order_gaps", "high_growth", "top_mean_accounts",
          "yearly_change", "quarterly_change", "rank_segments", "cohort_retention", "volume_segments", "volume_value_segments",
          "activity_segments", "mean_product_amounts", "rep_channel_counts", "channel_effectiveness", "region_channel", "active_accounts",
          "account_ranks"]
KW = {"sales_by_month": {"years": (1995, 2001), "detail": True}, "high_growth": {"per_year": 1}, "volume_segments": {"cuts": (15, 8)}}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    d = tmp_path_factory.mktemp("states")
    build(str(d), 31, hot=True)
    return str(d)


@pytest.mark.parametrize("region, bound, whole", [(None, 250_000, True), ("ASIA", 0, False)])
def test_served_from_states_equals_the_facts(spark, path, region, bound, whole):
    """``whole``: the states of all orders, which serve a scope as well."""
    star = Star.from_testdata(spark, path, broadcast_rows=bound)
    s = star if whole else scope_region(star, region)
    orders, events = states.order_states(s).persist(), states.event_states(s).persist()
    served = scope_region(states.with_states(s, orders, events), region if whole else None)
    for name in SERVED:
        want = rows(getattr(op, name)(star, region, **KW.get(name, {})))
        assert rows(getattr(op, name)(served, **KW.get(name, {}))) == want, (name, region)
    orders.unpersist()
    events.unpersist()


def leaves(df):
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [plan.apply(i) for i in range(plan.size())]


def test_dashboard_reads_the_facts_once(spark, path):
    star = Star.from_testdata(spark, path)
    for region in (None, "ASIA"):
        made = datasets(star, region, min_standard=10, min_poster=5)
        try:
            for name, df in made.items():
                read = [x.toString() for x in leaves(df) if x.nodeName().startswith("LogicalRelation")]
                facts = [x for x in read if "o_orderkey" in x or "l_orderkey" in x or "event_id" in x]
                assert not facts or name == "unit_prices", (name, facts)  # a price list has a row an order
            scans = made.shared[0]._jdf.queryExecution().executedPlan().toString()
            assert scans.count("FileScan") and scans.count("o_orderkey#") and scans.count("Location: InMemoryFileIndex(1 paths)[file:" + path + "/orders") <= 1
            assert rows(made["headline_sales"]) == rows(op.headline_sales(star, region))
            assert rows(made["volume_value_segments"]) == rows(op.volume_value_segments(star, region))
            assert rows(made["mean_product_amounts"]) == rows(op.mean_product_amounts(star, region))
            assert rows(made["sales_by_year"]) == rows(op.sales_by_year(star, region))
        finally:
            made.close()
        assert not made.shared[0].is_cached


def test_deviation_is_the_same_bits_whatever_the_partitions(spark):
    orders = spark.range(5000).select((F.col("id") % 7).alias("k"), ((F.col("id") * 7919 % 100003) / 100).cast("decimal(18,2)").alias("x"))
    orders = orders.unionAll(spark.sql("select 100L, cast(12.34 as decimal(18,2)) from range(9)")).unionAll(
        spark.sql("select 101L, cast(null as decimal(18,2))")).unionAll(spark.sql("select 102L, cast(1000000000000.01 as decimal(18,2))"))
    orders = orders.unionAll(spark.sql("select 103L, cast(900000000000.00 + id as decimal(18,2)) from range(3)"))

    def found(n):
        made = orders.repartition(n).groupBy("k").agg(F.count("x").alias("n"), E.money_sum("x").alias("s"), E.square_sum("x").alias("q"))
        return {r["k"]: (r["a"], r["b"]) for r in made.select("k", E.deviation("n", "s", "q").alias("a"), E.deviation("n", "s", "q", 0).alias("b")).collect()}

    one = found(1)
    assert one == found(8) == found(200)
    assert one[100] == (0.0, 0.0) and one[101] == (None, None) and one[102] == (None, 0.0)
    assert one[103][0] == 1.0  # no digits lost in large amounts
    plain = {r["k"]: r["d"] for r in orders.groupBy("k").agg(F.stddev_samp(F.col("x").cast("double")).alias("d")).collect()}
    for k in range(7):
        assert one[k][0] == pytest.approx(plain[k], rel=1e-9)


def test_segments_are_the_same_bits_whatever_the_partitions(spark, path):
    star = Star.from_testdata(spark, path)
    found = {str(rows(op.volume_value_segments(star.with_orders(lambda o, n=n: o.repartition(n)), cuts=(15, 8)))) for n in (1, 8, 40)}
    assert len(found) == 1


def test_refresh_reads_the_changed_year_only(spark, path, tmp_path):
    source = Star.from_testdata(spark, path)
    source.write_tables(str(tmp_path / "star"))
    star = Star.from_tables(spark, str(tmp_path / "star"))
    kept = str(tmp_path / "states")
    states.write_states(star.with_orders(lambda o: o.filter(~F.col("order_year").eqNullSafe(1999))), kept)
    assert states.changed_years(star, kept) == [1999]
    before = {f for f in states.read_states(spark, kept).inputFiles()}
    seen = []
    real = states.order_states
    states.order_states = lambda s: seen.append(real(s)) or seen[-1]
    try:
        states.refresh_states(star, kept, [1999])
    finally:
        states.order_states = real
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*order_year#\d+ = 1999", plan), plan
    after = {f for f in states.read_states(spark, kept).inputFiles()}
    assert before < after and all("order_year=1999" in f for f in after - before)  # no other file was touched
    assert states.changed_years(star, kept) == []
    assert rows(states.read_states(spark, kept)) == rows(states.order_states(star))
    # years that lost their orders, and orders without a time
    fewer = star.with_orders(lambda o: o.filter("order_year <> 1996"))
    assert states.changed_years(fewer, kept) == [1996, None]
    states.refresh_states(fewer, kept, [1996, None])
    assert rows(states.read_states(spark, kept)) == rows(states.order_states(fewer))
    served = states.with_states(fewer, states.read_states(spark, kept))
    for name in ("sales_by_year", "lifetime_value", "volume_segments", "rep_contribution"):
        assert rows(getattr(op, name)(served)) == rows(getattr(op, name)(fewer)), name
    years = states.with_states(star, states.read_states(spark, kept)).in_years((1997, 1998))
    assert rows(op.sales_by_region(years)) == rows(op.sales_by_region(star.in_years((1997, 1998))))


def test_command_line_keeps_the_roll_up(spark, path, tmp_path):
    from meridian.__main__ import main
    star = Star.from_testdata(spark, path)
    star.write_tables(str(tmp_path / "star"))
    for out in ("a", "b"):  # made, then used
        main(["--tables", str(tmp_path / "star"), "--out", str(tmp_path / out), "--states", str(tmp_path / "kept")])
        got = spark.read.parquet(str(tmp_path / out / "sales_by_year"))
        assert rows(got) == rows(op.sales_by_year(star))


def test_registered_states_are_covered():
    assert {"monthly_states", "rolled_up_totals", "maintained_sales_by_year", "maintained_lifetime_value"} <= set(registry.oracle_sql())
