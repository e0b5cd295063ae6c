"""Readers: the five-table star from quoted CSV files with text timestamps, and from Parquet."""

from __future__ import annotations

import os

from meridian import operators as op
from meridian.sources.star import Star

FILES = {
    "region.csv": ['"id","name"', '"1","Northeast"', '"2","Midwest"'],
    "sales_reps.csv": ['"id","name","region_id"', '"10","Sam Ortiz","1"',
                       '"11","Kira Lund","2"', '"12","Sian Bell","2"'],
    "accounts.csv": ['"id","name","website","primary_poc","sales_rep_id"',
                     '"1001","Acme","www.acme.example","Ana Ruiz","10"',
                     '"1011","Globex","www.globex.example","Bo Chen","11"',
                     '"1021","Initech","www.initech.example","Cy Diaz","12"'],
    "orders.csv": ['"id","account_id","occurred_at","standard_qty","gloss_qty","poster_qty","total",'
                   '"standard_amt_usd","gloss_amt_usd","poster_amt_usd","total_amt_usd"',
                   '"1","1001","2015-10-06 17:31:14","123","22","24","169","613.77","164.78","194.88","973.43"',
                   '"2","1001","2015-11-05 03:34:33","190","41","57","288","948.10","307.09","462.84","1718.03"',
                   '"3","1011","2016-12-26 08:53:24","85","47","0","132","424.15","352.03","0.00","776.18"'],
    "web_events.csv": ['"id","account_id","channel"', '"1","1001","direct"', '"2","1001","facebook"',
                       '"3","1021","direct"'],
}


def test_csv_star(spark, tmp_path):
    for name, lines in FILES.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    star = Star.from_csv(spark, str(tmp_path))
    assert dict(star.orders.dtypes)["occurred_at"] == "timestamp_ntz"
    got = {r["region_name"]: r["total_sales"] for r in op.sales_by_region(star).collect()}
    assert got == {"Northeast": 973.43 + 1718.03, "Midwest": 776.18}
    roster = [r["account_name"] for r in op.account_roster(star, "Midwest", rep_prefix="S").collect()]
    assert roster == ["Initech"]
    assert [r["account_name"] for r in
            op.account_roster(star, "Midwest", rep_contains="K").collect()] == ["Globex"]
    assert [r["account_name"] for r in op.account_roster(
        star, "Midwest", rep_contains="k", ignore_case=True).collect()] == ["Globex"]
    prices = op.unit_prices(star, min_standard=100, min_poster=50).collect()
    assert [(r["account_name"], round(r["unit_price"], 4)) for r in prices] == [
        ("Acme", round(1718.03 / 288.01, 4))]


def test_parquet_star_roundtrip(spark, tmp_path):
    for name, lines in FILES.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    star = Star.from_csv(spark, str(tmp_path))
    out = tmp_path / "pq"
    for t in ("region", "sales_reps", "accounts", "orders", "web_events"):
        getattr(star, t).write.parquet(str(out / f"{t}.parquet"))
    again = Star.from_tables(spark, str(out))
    assert sorted(op.sales_by_year(again).collect()) == sorted(op.sales_by_year(star).collect())
    assert os.path.isdir(out / "orders.parquet")


def test_written_star_prunes_years(spark, tmp_path):
    from tests.fixture import build
    src = tmp_path / "src"
    src.mkdir()
    build(str(src))
    star = Star.from_testdata(spark, str(src))
    star.write_tables(str(tmp_path / "star"))
    again = Star.from_tables(spark, str(tmp_path / "star"))
    assert "order_year" in again.orders.columns
    for fn in (op.sales_by_year, op.lifetime_value, op.quarterly_change, op.rank_segments):
        assert sorted(fn(again).collect()) == sorted(fn(star).collect())
    df = op.sales_by_month(again, years=(1995, 1999), detail=True)
    assert sorted(df.collect()) == sorted(
        op.sales_by_month(star, years=(1995, 1999), detail=True).collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [order_year" in plan and "IN (1995,1999)" in plan


def test_views_and_catalog_roundtrip(spark):
    star = Star.from_testdata(spark, "/root/testdata/sf0.001")
    star.register_views(prefix="mer_")
    sql = spark.sql("""
        SELECT r.name AS region_name, CAST(SUM(o.total_amt_usd) AS DOUBLE) AS total_sales
        FROM mer_orders o JOIN mer_accounts a ON o.account_id = a.id
        JOIN mer_sales_reps sr ON a.sales_rep_id = sr.id JOIN mer_region r ON sr.region_id = r.id
        GROUP BY r.name""")
    assert sorted(sql.collect()) == sorted(op.sales_by_region(star).collect())
    for t in ("region", "sales_reps", "accounts", "orders", "web_events"):
        spark.table(f"mer_{t}").createOrReplaceTempView(t)
    again = Star.from_catalog(spark)
    assert dict(again.orders.dtypes)["total_amt_usd"] == "decimal(18,2)"
    assert sorted(op.churn(again).collect()) == sorted(op.churn(star).collect())


def test_star_from_frames(spark):
    from pyspark.sql import Row
    region = spark.createDataFrame([Row(id=1, name="North")], "id int, name string")
    reps = spark.createDataFrame([Row(id=7, name="Ann", region_id=1)],
                                 "id int, name string, region_id int")
    accounts = spark.createDataFrame(
        [Row(id=3, name="Acme", website="a", primary_poc="p", sales_rep_id=7)],
        "id long, name string, website string, primary_poc string, sales_rep_id int")
    orders = spark.sql("SELECT 1L AS id, 3L AS account_id, "
                       "TIMESTAMP_NTZ'2016-05-01 00:00:00' AS occurred_at, 1L AS standard_qty, "
                       "0L AS gloss_qty, 0L AS poster_qty, 1L AS total, "
                       "CAST(2.50 AS DECIMAL(18,2)) AS standard_amt_usd, "
                       "CAST(0 AS DECIMAL(18,2)) AS gloss_amt_usd, "
                       "CAST(0 AS DECIMAL(18,2)) AS poster_amt_usd, "
                       "CAST(2.50 AS DECIMAL(18,2)) AS total_amt_usd")
    events = spark.createDataFrame([Row(id=1, account_id=3, channel="direct")],
                                   "id long, account_id long, channel string")
    star = Star.from_frames(region, reps, accounts, orders, events)
    assert [tuple(r) for r in op.sales_by_region(star).collect()] == [("North", 2.5)]
    assert [tuple(r) for r in op.rep_channel_counts(star).collect()] == [("Ann", "direct", 1)]


def test_csv_rows_that_do_not_fit_are_left_out_and_listed(spark, tmp_path):
    bad = {"region.csv": '"x","Nowhere"', "sales_reps.csv": '"13","Half a r', "accounts.csv": '"1031","Short"',
           "orders.csv": '"4","1001","2015-11-05 03:34:33","many","41","57","288","948.10","307.09","462.84","1718.03"',
           "web_events.csv": '"9999999999999999999999","1001","direct"'}
    for name, lines in FILES.items():
        lines = [*lines[:2], *([bad[name]] if name != "sales_reps.csv" else []), *lines[2:], *([bad[name]] if name == "sales_reps.csv" else [])]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    star = Star.from_csv(spark, str(tmp_path))
    for name, lines in FILES.items():
        table = getattr(star, name[:-4])
        # whatever is read of a row, the same rows count
        assert table.count() == len(table.collect()) == len(table.select("id").collect()), name
        if name != "sales_reps.csv":
            assert table.count() == len(lines) - 1, name
    got = {r["region_name"]: r["total_sales"] for r in op.sales_by_region(star).collect()}
    assert got == {"Northeast": 2691.46, "Midwest": 776.18}
    listed = {r["table"]: r["text"] for r in Star.rejected_rows(spark, str(tmp_path)).collect()}
    for name in ("region", "accounts", "orders", "web_events"):
        assert listed[name] == bad[f"{name}.csv"]
    assert Star.rejected_rows(spark, str(tmp_path)).count() == len(listed)
    import pytest
    with pytest.raises(Exception, match="does not fit its schema"):
        Star.from_csv(spark, str(tmp_path), bad_rows="fail").orders.collect()


def test_a_table_that_grows_is_counted_again(spark, tmp_path):
    for name, lines in FILES.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "star")
    Star.from_csv(spark, str(tmp_path)).write_tables(path)
    assert Star.from_tables(spark, path, broadcast_rows=5).fits("accounts")
    more = spark.range(2000, 2010).selectExpr("id", "'n' name", "'w' website", "'p' primary_poc", "10 sales_rep_id")
    more.write.mode("append").parquet(f"{path}/accounts.parquet")
    assert not Star.from_tables(spark, path, broadcast_rows=5).fits("accounts")


def test_reading_the_testdata_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("reading", "reading the star")
    Star.from_testdata(spark, "/root/testdata/sf0.001")
    assert list(tracker.getJobIdsForGroup("reading")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
