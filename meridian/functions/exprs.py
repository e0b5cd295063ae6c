"""Column expressions shared by the analyses.

Cross-engine exactness rules (the same rules are written into the oracle SQL):

* money (``decimal(18,2)`` in the tables) is taken as integer cents and summed as a decimal of
  28 digits (38 when sums are summed): exact, so a sum does not depend on addition order, and
  wide enough that no group of any size wraps, with ANSI mode on or off; it leaves as
  ``double`` only at the end, and a mean is that double over a count;
* rounding of a ratio is done in integer arithmetic, half away from zero;
* division by zero gives NULL (``try_divide``), never an error or infinity.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.sources.schema import MONEY

# English month names, in calendar order.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June",
               "July", "August", "September", "October", "November", "December"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def cents(c: str | Column) -> Column:
    """Money as exact integer cents."""
    return (money(c) * 100).cast("long")


def sum_cents(c: str | Column) -> Column:
    """Exact sum of cents: of longs as ``decimal(28,0)``, of such sums as ``decimal(38,0)``."""
    return F.sum(col(c).cast("decimal(18,0)"))


def merge_cents(c: str | Column) -> Column:
    """Exact sum of sums of cents."""
    return F.sum(col(c).cast("decimal(28,0)"))


def money_sum(c: str | Column) -> Column:
    """Exact sum of a money column, in cents (NULL when there is no value)."""
    return sum_cents(cents(c))


def square_sum(c: str | Column) -> Column:
    """Exact sum of the squares of a money column, in cents."""
    x = cents(c).cast("decimal(18,0)")
    return F.sum((x * x).cast("decimal(37,0)")).cast("decimal(38,0)")


def deviation(n: str, sum_cents: str, squares: str, ddof: int = 1) -> Column:
    """Standard deviation in USD from a count, an exact sum and an exact sum of squares in cents.

    About the whole part q of the mean: sum (x - q)^2 is exact in integers, and what is left of
    the mean, below one cent, is taken off in one step. Nothing depends on the order of addition, and
    equal values give 0. NULL where ``n - ddof`` is not positive."""
    k, s, sq = (f"CAST({c} AS DECIMAL(38,0))" for c in (n, sum_cents, squares))
    q = f"CAST({s} div nullif({n}, 0) AS DECIMAL(38,0))"
    about = f"CAST({sq} - 2 * {q} * {s} + {k} * {q} * {q} AS DOUBLE)"
    rest = f"CAST({s} - {k} * {q} AS DOUBLE)"
    left = F.expr(f"{about} - {rest} * {rest} / nullif(CAST({n} AS DOUBLE), 0D)")
    return F.when(F.col(n) > ddof, F.sqrt(F.greatest(left, F.lit(0.0)) / (F.col(n) - ddof)) / 100)


def exact_mean(c: str | Column, dp: int = 4) -> Column:
    """Mean of doubles rounded to ``dp``, from an exact sum of decimals: free of the order of addition."""
    x = col(c).cast("decimal(28,8)")
    return F.round(F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double")), dp)


def usd(cents_col: str | Column) -> Column:
    """Cents -> USD as double, for output (one correctly rounded division)."""
    return col(cents_col).cast("double") / 100


def mean(sum_cents: str | Column, n: str | Column) -> Column:
    """Mean USD from an exact cents sum and a count: NULL for an empty group."""
    return F.try_divide(usd(sum_cents), col(n).cast("double"))


def half_up_units(num: str, den: str, dp: int, scale: int, in_scale: int) -> str:
    """SQL text of round(scale * num / den, dp) * 10**dp as an exact integer, half away from zero;
    NULL when ``den`` is 0 or NULL. ``num`` and ``den`` are SQL expressions (a column name
    is one) of integers or decimals with at most ``in_scale`` fractional digits.

    One expression: integral division (``div``) of non-negative decimals."""
    lift = 10 ** in_scale
    n = f"CAST(({num}) * {lift} AS DECIMAL(38,0))"
    d = f"NULLIF(CAST(({den}) * {lift} AS DECIMAL(38,0)), 0)"
    k = f"((abs({n}) * {2 * scale * 10 ** dp} + abs({d})) div (abs({d}) * 2))"
    return f"CASE WHEN sign({n}) * sign({d}) < 0 THEN -{k} ELSE {k} END"


def _half_up_units(num: str, den: str, dp: int, scale: int, in_scale: int) -> Column:
    return F.expr(half_up_units(num, den, dp, scale, in_scale))


def half_up_ratio(num: str, den: str, dp: int = 2, scale: int = 1, in_scale: int = 0) -> Column:
    """round(scale * num / den, dp) as a double, half away from zero, computed exactly."""
    return _half_up_units(num, den, dp, scale, in_scale).cast("double") / (10 ** dp)


def half_up_decimal(num: str, den: str, dp: int = 4, scale: int = 1,
                    in_scale: int = 0) -> Column:
    """Same rounding as :func:`half_up_ratio`, kept as an exact ``decimal(38, dp)``."""
    units = _half_up_units(num, den, dp, scale, in_scale).cast("decimal(38,0)")
    return (units / F.lit(10 ** dp).cast("decimal(38,0)")).cast(f"decimal(38,{dp})")


def percent(num: str, den: str, dp: int = 2, in_scale: int = 0) -> Column:
    """round(100 * num / den, dp), exact, half away from zero."""
    return half_up_ratio(num, den, dp=dp, scale=100, in_scale=in_scale)


def bigint(c: str | Column) -> Column:
    return col(c).cast("long")


def year(c: str | Column) -> Column:
    return F.year(col(c)).cast("long")


def month(c: str | Column) -> Column:
    return F.month(col(c)).cast("long")


def quarter(c: str | Column) -> Column:
    return F.quarter(col(c)).cast("long")


def day(c: str | Column) -> Column:
    return F.dayofmonth(col(c)).cast("long")


def _ts_literal(df: DataFrame, name: str, y: int) -> Column:
    return F.lit(datetime(y, 1, 1).strftime("%Y-%m-%d %H:%M:%S")).cast(df.schema[name].dataType)


def in_years(df: DataFrame, name: str, years: Iterable[int],
             partition_col: str = "order_year") -> Column:
    """``year(name) IN years`` as OR-ed half-open ranges, which Parquet can push down; when
    the frame carries the year partition column, also a test on it, which prunes directories
    (the two agree, the partition column being the year of ``name``)."""
    years = sorted(set(years))
    cond = None
    for y in years:
        part = (F.col(name) >= _ts_literal(df, name, y)) & (F.col(name) < _ts_literal(df, name, y + 1))
        cond = part if cond is None else cond | part
    if cond is None:
        return F.lit(False)
    if partition_col in df.columns:
        cond = F.col(partition_col).isin(years) & cond
    return cond


def on_day(df: DataFrame, name: str, month: int, day: int, years: Iterable[int] | None = None,
           partition_col: str = "order_year") -> Column:
    """``name`` lies on this calendar day, of any year or, as ranges, of the given years."""
    if years is None:
        return (F.month(name) == month) & (F.dayofmonth(name) == day)
    years = list(years)
    kind, cond = df.schema[name].dataType, None
    for y in sorted(set(years)):
        try:
            start = datetime(y, month, day)
        except ValueError:  # no such day in that year
            continue
        lo, hi = (F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast(kind) for t in (start, start + timedelta(days=1)))
        part = (F.col(name) >= lo) & (F.col(name) < hi)
        cond = part if cond is None else cond | part
    if cond is None:
        return F.lit(False)
    return F.col(partition_col).isin(sorted(set(years))) & cond if partition_col in df.columns else cond


def label_by_cuts(cuts: Sequence[tuple[Column, str]], default: str) -> Column:
    """Searched CASE: the first predicate that holds gives its label, else ``default``."""
    out = None
    for pred, label in cuts:
        out = F.when(pred, label) if out is None else out.when(pred, label)
    return F.lit(default) if out is None else out.otherwise(default)


def month_name(c: str | Column) -> Column:
    """English month name; NULL for a NULL month. (``element_at`` over a literal array
    answers a NULL index from a column with the last element, so NULL is handled first.)"""
    names = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), col(c).cast("int"))
    return F.when(col(c).isNotNull(), names)


def like(c: str | Column, prefix: str | None, contains: str | None, ignore_case: bool) -> Column:
    """Name pattern of the rosters: prefix and/or substring, case-sensitive by default."""
    target = F.lower(col(c)) if ignore_case else col(c)
    cond = F.lit(True)
    if prefix is not None:
        cond = cond & target.startswith(prefix.lower() if ignore_case else prefix)
    if contains is not None:
        cond = cond & target.contains(contains.lower() if ignore_case else contains)
    return cond
