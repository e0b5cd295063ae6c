"""Expression helpers: exact half-up ratios against Python's Decimal, year ranges, labels."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.functions import exprs as E


def expected(num: int, den: int, dp: int, scale: int) -> float | None:
    if den == 0:
        return None
    q = Decimal(num * scale) / Decimal(den)
    return float(q.quantize(Decimal(1).scaleb(-dp), rounding=ROUND_HALF_UP))


pairs = st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(-10**6, 10**6)),
                 min_size=1, max_size=200)


@settings(max_examples=5, deadline=None)
@given(pairs)
def test_half_up_ratio_is_exact(spark, rows):
    df = spark.createDataFrame(rows, "n long, d long")
    got = df.select("n", "d", E.half_up_ratio("n", "d", dp=2).alias("r"),
                    E.percent("n", "d").alias("p"),
                    E.half_up_decimal("n", "d", dp=4).alias("q")).collect()
    for r in got:
        assert r["r"] == expected(r["n"], r["d"], 2, 1)
        assert r["p"] == expected(r["n"], r["d"], 2, 100)
        assert (None if r["q"] is None else float(r["q"])) == expected(r["n"], r["d"], 4, 1)


def test_ties_round_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (5, 1000), (-5, 1000)], "n long, d long")
    got = [r["r"] for r in df.select(E.half_up_ratio("n", "d", dp=2).alias("r")).collect()]
    assert got == [0.13, -0.13, 0.01, -0.01]


def test_money_cents_and_mean(spark):
    df = spark.createDataFrame([("0.10",), ("0.20",), (None,)], "x string").select(
        F.col("x").cast("decimal(18,2)").alias("x"))
    r = df.agg(E.usd(E.money_sum("x")).alias("s"),
               E.mean(E.money_sum("x"), F.count("x")).alias("m")).collect()[0]
    assert r["s"] == 0.3 and r["m"] == 0.15


def test_year_ranges_and_labels(spark):
    df = spark.createDataFrame([("1995-12-31 23:59:59",), ("1996-01-01 00:00:00",),
                                ("2001-06-01 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    kept = [str(r["t"]) for r in df.filter(E.in_years(df, "t", [1995, 2001])).collect()]
    assert kept == ["1995-12-31 23:59:59", "2001-06-01 00:00:00"]
    lab = E.label_by_cuts([(F.col("v") > 10, "high"), (F.col("v") > 5, "mid")], "low")
    got = [r["l"] for r in spark.createDataFrame([(11,), (10,), (6,), (5,), (None,)], "v int")
           .select(lab.alias("l")).collect()]
    assert got == ["high", "mid", "mid", "low", "low"]
    names = [r["m"] for r in spark.createDataFrame([(1,), (12,), (None,)], "v int")
             .select(E.month_name("v").alias("m")).collect()]
    assert names == ["January", "December", None]
