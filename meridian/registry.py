"""Registered queries on the driver's testdata, each with an independent DuckDB oracle.

The oracle SQL starts from three relations (people: accounts with their representative and region;
buys: orders; wallet: orders summed per account) and reaches each result by another way than
the library: lists and list positions for ranks, years and gaps, FILTER and QUALIFY,
semi-joins for the scope, self-joins on row numbers for changes. It keeps the rules that make
values comparable: money summed exactly and output as double, means as that double over a
count, ratios rounded half-up in integer arithmetic, years and integer sums as BIGINT.

Parameters are the testdata counterparts of the reference's constants (its region,
name patterns, years and thresholds select nothing sensible in this data).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian import operators as op
from meridian.functions import exprs as E
from meridian.plans import states
from meridian.plans.scope import scope_region
from meridian.plans.scratch import new_path
from meridian.sources.star import Star

REGION = "ASIA"
REP_PREFIX, REP_CONTAINS = "NATION_1", "2"
REP_CONTAINS_ANY_CASE = "nation_2"
MIN_STANDARD, MIN_POSTER = 60, 50
YEARS = (1995, 2001)
BEST_MONTH_ACCOUNT = "Customer#000000055"
VOLUME_CUTS = (15, 8)
VALUE_CUT = 250000
GROWTH_PER_YEAR = 2
ACTIVITY_CUTS = (20, 10)
CHANNELS = ["click", "error", "purchase", "signup", "view"]

# ---- the testdata tables as people, buys, basket, wallet and clicks ----------------------------

_SPLIT = {"standard": "A", "gloss": "N", "poster": "R"}

_LINES = ", ".join(
    f"CAST(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}') AS BIGINT) AS {p}_q, "
    f"sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = '{f}') AS {p}_a"
    for p, f in _SPLIT.items())
_ZEROED = ", ".join(f"ifnull({p}_q, 0) AS {p}_qty, ifnull({p}_a, 0) AS {p}_amt" for p in _SPLIT)

PRELUDE = f"""WITH
people AS (
  SELECT c_custkey AS acct, c_name AS who, c_mktsegment AS contact,
         n_nationkey AS rep_id, n_name AS rep, r_regionkey AS reg_id, r_name AS reg
  FROM customer LEFT JOIN (nation LEFT JOIN region ON n_regionkey = r_regionkey)
       ON c_nationkey = n_nationkey),
buys AS (
  SELECT o_orderkey AS ord, o_custkey AS acct, o_orderdate AS ts, year(o_orderdate)::BIGINT AS yr,
         month(o_orderdate)::BIGINT AS mon, o_totalprice::DECIMAL(18,2) AS amt
  FROM orders),
basket AS (
  SELECT buys.*, {_ZEROED}, {" + ".join(f"ifnull({p}_q, 0)" for p in _SPLIT)} AS units
  FROM buys LEFT JOIN (SELECT l_orderkey, {_LINES} FROM lineitem GROUP BY l_orderkey) ON l_orderkey = ord),
wallet AS (
  SELECT acct, count(ord) AS n, sum(amt) AS spent, sum(amt)::DOUBLE / nullif(count(amt), 0) AS mean_amt,
         stddev_samp(amt::DOUBLE) AS dev_samp, stddev_pop(amt::DOUBLE) AS dev_pop, min(ts) AS first_ts,
         list(DISTINCT yr) FILTER (WHERE yr IS NOT NULL) AS yrs
  FROM buys GROUP BY acct),
clicks AS (SELECT event_id AS ev, user_id AS acct, event_type AS channel FROM events)
"""

SCOPE = f"acct IN (SELECT acct FROM people WHERE reg = '{REGION}')"


def _q(body: str) -> str:
    return PRELUDE + body


def _only(scoped: bool, *conditions: str, inside: str = f"reg = '{REGION}'") -> str:
    """A WHERE clause of the conditions and, if scoped, ``inside``."""
    held = [*conditions, *([inside] if scoped else [])]
    return " WHERE " + " AND ".join(held) if held else ""


def usd(x: str) -> str:
    return f"({x})::DOUBLE"


def mean(x: str) -> str:
    return f"sum({x})::DOUBLE / nullif(count({x}), 0)"


def half_up(num: str, den: str, dp: int = 2, scale: int = 1, in_scale: int = 0) -> str:
    """Exact round(scale * num / den, dp), half up, for num >= 0 and den > 0."""
    n = f"(({num}) * {10 ** in_scale})::HUGEINT"
    d = f"nullif((({den}) * {10 ** in_scale})::HUGEINT, 0)"
    return f"(({2 * scale * 10 ** dp} * {n} + {d}) // (2 * {d}))::DOUBLE / {10 ** dp}"


def label(names: tuple[str, ...], *beyond: str) -> str:
    """The first name, moved on by one for each condition that holds."""
    return f"[{', '.join(repr(n) for n in names)}][1 + " + " + ".join(f"({c})::INT" for c in beyond) + "]"


# ---- queries ------------------------------------------------------------------------------

Fn = Callable[[Star], DataFrame]
ENTRIES: dict[str, tuple[Fn, str | None]] = {}


def register(name: str, fn: Fn, sql: str | None) -> None:
    ENTRIES[name] = (fn, sql)


def both(name: str, fn: Callable[[Star, str | None], DataFrame], sql: Callable[[bool], str]) -> None:
    """The entry for all regions and ``<name>_scoped`` for REGION."""
    register(name, lambda s: fn(s, None), _q(sql(False)))
    register(f"{name}_scoped", lambda s: fn(s, REGION), _q(sql(True)))


register("region_catalog", op.region_catalog, "SELECT DISTINCT r_name AS name FROM region")

_ROSTER = "SELECT reg AS region, rep AS rep_name, who AS account_name FROM people"
for _name, _args, _extra in (
        ("account_roster", {}, ()),
        ("account_roster_prefix", {"rep_prefix": REP_PREFIX}, (f"left(rep, {len(REP_PREFIX)}) = '{REP_PREFIX}'",)),
        ("account_roster_contains", {"rep_contains": REP_CONTAINS}, (f"instr(rep, '{REP_CONTAINS}') > 0",)),
        ("account_roster_ignore_case", {"rep_contains": REP_CONTAINS_ANY_CASE, "ignore_case": True},
         (f"rep ILIKE '%{REP_CONTAINS_ANY_CASE.replace('_', '!_')}%' ESCAPE '!'",))):
    register(_name, lambda s, _a=_args: op.account_roster(s, REGION, **_a), _q(_ROSTER + _only(True, *_extra)))

both("accounts_per_rep", lambda s, r: op.accounts_per_rep(s, r), lambda sc:
     "SELECT rep AS rep_name, count(*) AS account_count FROM people" + _only(sc, "reg_id IS NOT NULL") + " GROUP BY ALL")

_UNIT_PRICE = f"{usd('amt')} / ({usd('units')} + 0.01::DOUBLE) AS unit_price"
_UNITS = "SELECT {cols} FROM people JOIN basket USING (acct)"
register("unit_prices", lambda s: op.unit_prices(s, min_standard=MIN_STANDARD),
         _q(_UNITS.format(cols=f"reg AS region, who AS account_name, {_UNIT_PRICE}")
            + _only(False, "reg_id IS NOT NULL", f"standard_qty > {MIN_STANDARD}")))
register("unit_prices_poster",
         lambda s: op.unit_prices(s, min_standard=MIN_STANDARD, min_poster=MIN_POSTER),
         _q(_UNITS.format(cols=f"reg AS region, who AS account_name, {_UNIT_PRICE}")
            + _only(False, "reg_id IS NOT NULL", f"least(standard_qty - {MIN_STANDARD}, poster_qty - {MIN_POSTER}) > 0")))
register("unit_prices_scoped",
         lambda s: op.unit_prices(s, REGION, min_standard=MIN_STANDARD, min_poster=MIN_POSTER,
                                  with_region=False),
         _q(_UNITS.format(cols=f"who AS account_name, {_UNIT_PRICE}")
            + _only(True, f"standard_qty > {MIN_STANDARD}", f"poster_qty > {MIN_POSTER}")))

both("mean_product_amounts", lambda s, r: op.mean_product_amounts(s, r), lambda sc:
     "SELECT who AS account_name, " + ", ".join(f"{mean(f'{p}_amt')} AS avg_{p}_amt_usd" for p in _SPLIT)
     + " FROM basket JOIN people USING (acct)" + _only(sc) + " GROUP BY ALL")

both("rep_channel_counts", lambda s, r: op.rep_channel_counts(s, r), lambda sc:
     "SELECT rep AS sales_rep_name, channel, count(*) AS number_of_occurrences FROM people JOIN clicks USING (acct)"
     + _only(sc, "rep_id IS NOT NULL") + " GROUP BY ALL")
_LISTED = ", ".join(f"'{c}'" for c in CHANNELS[1:])
both("rep_channel_matrix", lambda s, r: op.rep_channel_matrix(s, r, CHANNELS[1:]), lambda sc:
     "SELECT rep AS sales_rep_name, " + ", ".join(f"count(*) FILTER (WHERE channel = '{c}') AS {c}" for c in CHANNELS[1:])
     + f", count(*) FILTER (WHERE ifnull(channel, '') NOT IN ({_LISTED})) AS other FROM people JOIN clicks USING (acct)"
     + _only(sc, "rep_id IS NOT NULL") + " GROUP BY ALL")
# the columns follow the data
register("rep_channel_matrix_all", op.rep_channel_matrix,
         PRELUDE + ", met AS (SELECT rep AS sales_rep_name, ifnull(channel, 'null') AS channel FROM people JOIN clicks USING (acct) "
         "WHERE rep_id IS NOT NULL) SELECT * FROM (PIVOT met ON channel USING count(*) GROUP BY sales_rep_name)")

_YEARLY = f"SELECT yr AS year, {usd('sum(amt)')} AS total_usd FROM buys"
both("sales_by_year", lambda s, r: op.sales_by_year(s, r), lambda sc: _YEARLY + _only(sc, inside=SCOPE) + " GROUP BY ALL")
both("sales_year_extremes", lambda s, r: op.sales_year_extremes(s, r), lambda sc:
     f", y AS ({_YEARLY}{_only(sc, inside=SCOPE)} GROUP BY ALL HAVING count(amt) > 0) SELECT kind, year, total_usd FROM "
     "(SELECT y.*, unnest([{'kind': 'lowest', 'place': total_usd}, {'kind': 'highest', 'place': -total_usd}], recursive := true) FROM y) "
     "QUALIFY row_number() OVER (PARTITION BY kind ORDER BY place, year) = 1")
both("seasonality", lambda s, r: op.seasonality(s, r, names=r is not None), lambda sc:
     f"SELECT mon AS month, {usd('sum(amt)')} AS total_sales"
     + (", monthname(make_date(2000, mon, 1)) AS month_name" if sc else "")
     + " FROM buys" + _only(sc, inside=SCOPE) + " GROUP BY mon")

_YEARS = f"yr BETWEEN {min(YEARS)} AND {max(YEARS)} AND list_contains({list(YEARS)}, yr)"
register("sales_by_month", lambda s: op.sales_by_month(s, years=YEARS),
         _q(f"SELECT yr AS year, mon AS month, {usd('sum(amt)')} AS total_usd FROM buys WHERE {_YEARS} GROUP BY ALL"))
both("sales_by_month_detail", lambda s, r: op.sales_by_month(s, r, years=YEARS, detail=True), lambda sc:
     f"SELECT yr AS year, mon AS month, {usd('sum(amt)')} AS total_usd, {mean('amt')} AS avg_order_amt, "
     f"count(ord) AS total_orders, {usd('max(amt)')} AS max_order_amt, strftime(min(ts), '%Y-%m') AS year_month "
     "FROM buys" + _only(sc, _YEARS, inside=SCOPE) + " GROUP BY yr, mon")

both("sales_on_day", lambda s, r: op.sales_on_day(s, r, month=1, day=1), lambda sc:
     f"SELECT yr AS year, mon AS month, day(ts)::BIGINT AS day, {usd('sum(amt)')} AS total_usd "
     "FROM buys" + _only(sc, "strftime(ts, '%m%d') = '0101'", inside=SCOPE) + " GROUP BY ALL")
register("sales_on_day_years", lambda s: op.sales_on_day(s, month=1, day=1, years=YEARS),
         _q(f"SELECT yr AS year, mon AS month, day(ts)::BIGINT AS day, {usd('sum(amt)')} AS total_usd "
            f"FROM buys WHERE strftime(ts, '%m%d') = '0101' AND {_YEARS} GROUP BY ALL"))


def _best_month(product: str, scoped: bool = False) -> str:
    return (f"SELECT who AS account_name, yr AS year, mon AS month, {usd(f'sum({product}_amt)')} AS {product}_total_usd "
            "FROM basket JOIN people USING (acct)" + _only(scoped, f"who = '{BEST_MONTH_ACCOUNT}'") + " GROUP BY 1, 2, 3 "
            f"QUALIFY row_number() OVER (ORDER BY sum({product}_amt) DESC, yr, mon) = 1")


register("best_month", lambda s: op.best_month(s, BEST_MONTH_ACCOUNT), _q(_best_month("gloss")))
register("best_month_standard", lambda s: op.best_month(s, BEST_MONTH_ACCOUNT, "standard_amt_usd"), _q(_best_month("standard")))
register("best_month_scoped", lambda s: op.best_month(s, BEST_MONTH_ACCOUNT, region=REGION), _q(_best_month("gloss", True)))

_SOLD = "FROM people JOIN buys USING (acct)"
both("sales_by_region", lambda s, r: op.sales_by_region(s, r), lambda sc:
     f"SELECT reg AS region_name, {usd('sum(amt)')} AS total_sales {_SOLD}" + _only(sc, "reg_id IS NOT NULL") + " GROUP BY reg")
register("sales_by_region_years", lambda s: op.sales_by_region(s.in_years(YEARS)),
         _q(f"SELECT reg AS region_name, {usd('sum(amt)')} AS total_sales {_SOLD} WHERE reg_id IS NOT NULL AND {_YEARS} GROUP BY reg"))
both("headline_sales", lambda s, r: op.headline_sales(s, r), lambda sc:
     f"SELECT round_even({usd('sum(amt)')}, 0) AS total_sales {_SOLD}" + _only(sc, "reg_id IS NOT NULL"))
both("mean_order_by_region", lambda s, r: op.mean_order_by_region(s, r, formatted=r is not None), lambda sc:
     f"SELECT reg AS region_name, {mean('amt')} AS avg_order_size"
     + (f", concat('$', format('{{:,.2f}}', {mean('amt')})) AS avg_order_size_text" if sc else "")
     + f" {_SOLD}" + _only(sc, "reg_id IS NOT NULL") + " GROUP BY reg")

_OWNERS = "FROM people LEFT JOIN wallet USING (acct)"
both("lifetime_value", lambda s, r: op.lifetime_value(s, r, marker=r is not None), lambda sc:
     f"SELECT acct AS account_id, who AS account_name, {usd('spent')} AS total_spent, ifnull(n, 0) AS total_orders, "
     "mean_amt AS average_order_amount" + (", ifnull(mean_amt, 1.0) AS marker_size" if sc else "") + f" {_OWNERS}" + _only(sc))

both("channel_effectiveness", lambda s, r: op.channel_effectiveness(s, r), lambda sc:
     "SELECT channel, sum(k)::BIGINT AS total_events, count(acct) AS unique_accounts, "
     "count(acct) FILTER (WHERE acct IN (SELECT acct FROM people)) AS total_customers "
     "FROM (SELECT channel, acct, count(ev) AS k FROM clicks" + _only(sc, inside=SCOPE) + " GROUP BY ALL) GROUP BY channel")
both("rep_acquisition", lambda s, r: op.rep_acquisition(s, r), lambda sc:
     "SELECT n_name AS sales_representative, count(DISTINCT acct) AS new_customers_acquired, "
     "year(min(first_ts))::BIGINT AS first_order_year "
     "FROM nation LEFT JOIN (SELECT rep_id, acct, first_ts " + _OWNERS + ") ON rep_id = n_nationkey"
     + _only(sc, inside=f"n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = '{REGION}')") + " GROUP BY n_name")
both("churn", lambda s, r: op.churn(s, r), lambda sc:
     "SELECT count(buyer) AS active_customers, count(*) - count(buyer) AS churned_customers FROM (SELECT DISTINCT acct FROM people"
     + _only(sc, "acct IS NOT NULL") + ") LEFT JOIN (SELECT DISTINCT acct AS buyer FROM buys) ON buyer = acct")
both("region_channel", lambda s, r: op.region_channel(s, r), lambda sc:
     "SELECT reg AS region_name, channel, count(ev) AS total_events, count(DISTINCT people.acct) AS unique_accounts_impacted "
     "FROM clicks LEFT JOIN people ON people.acct = clicks.acct" + _only(sc) + " GROUP BY ALL")


def _ranks(scoped: bool, cuts: tuple[int, int] = (3, 10)) -> str:
    """A dense rank is a value's place in the sorted list of the values found; no value comes last."""
    def place(found: str, value: str) -> str:
        return f"ifnull(list_position((SELECT {found} FROM tops), {value}), (SELECT len({found}) + 1 FROM tops))"

    return (f", own AS (SELECT who, ifnull(n, 0) AS n, spent {_OWNERS}{_only(scoped)}), "
            "tops AS (SELECT list_reverse_sort(list(DISTINCT n)) AS ns, "
            "ifnull(list_reverse_sort(list(DISTINCT spent) FILTER (WHERE spent IS NOT NULL)), []) AS ss FROM own), "
            f"placed AS (SELECT *, {place('ns', 'n')} AS o, {place('ss', 'spent')} AS s FROM own) "
            f"SELECT who AS account_name, n AS total_orders, {usd('spent')} AS total_spend, "
            + label(("Highly Active", "Moderately Active", "Less Active"), f"o > {cuts[0]}", f"o > {cuts[1]}")
            + " AS order_activity_segment, "
            + label(("High Spender", "Moderate Spender", "Low Spender"), f"s > {cuts[0]}", f"s > {cuts[1]}")
            + " AS spending_segment FROM placed")


both("rank_segments", lambda s, r: op.rank_segments(s, r), _ranks)
register("rank_segments_wide", lambda s: op.rank_segments(s, cuts=(3, 1001)), _q(_ranks(False, (3, 1001))))

both("cohort_retention", lambda s, r: op.cohort_retention(s, r), lambda sc:
     "SELECT list_min(yrs) AS first_order_year, count(acct) AS total_customers, "
     "count(acct) FILTER (WHERE len(yrs) > 1) AS retained_customers, count(acct) FILTER (WHERE len(yrs) > 0) AS new_customers, "
     + half_up("count(acct) FILTER (WHERE len(yrs) > 1)", "count(acct)", scale=100)
     + " AS retention_rate FROM wallet" + _only(sc, inside=SCOPE) + " GROUP BY list_min(yrs)")

_VOLUME = label(("High Volume", "Moderate Volume", "Low Volume"), f"ifnull(n, 0) <= {VOLUME_CUTS[0]}",
                f"ifnull(n, 0) <= {VOLUME_CUTS[1]}") + " AS order_volume_segment"


def _volumes(scoped: bool, dev: str = "dev_samp", value: bool = False) -> str:
    high = f", if(ifnull(mean_amt, 0) > {VALUE_CUT}, 'High Value', 'Low Value') AS order_value_segment" if value else ""
    return (f"SELECT {_VOLUME}{high}, count(acct) AS num_accounts, round(avg(mean_amt), 4) AS avg_order_size_usd, "
            f"round(avg({dev}), 4) AS avg_order_std_dev_usd"
            + (f", {usd('sum(spent)')} AS total_sales_in_segment" if value else "")
            + f" {_OWNERS}{_only(scoped)} GROUP BY ALL")


both("volume_segments", lambda s, r: op.volume_segments(s, r, cuts=VOLUME_CUTS), _volumes)
register("volume_segments_population", lambda s: op.volume_segments(s, cuts=VOLUME_CUTS, ddof=0), _q(_volumes(False, "dev_pop")))
both("volume_value_segments", lambda s, r: op.volume_value_segments(s, r, cuts=VOLUME_CUTS, value_cut=VALUE_CUT),
     lambda sc: _volumes(sc, value=True))

_NAMED = "JOIN (SELECT c_custkey, c_name AS account_name FROM customer) ON c_custkey = acct"
both("high_growth", lambda s, r: op.high_growth(s, r, per_year=GROWTH_PER_YEAR), lambda sc:
     "SELECT account_name, list_min(ys) AS first_order_year, list_max(ys) AS last_order_year, total_orders, "
     "len(ys) AS order_years_count, avg_order_amt_usd, 'High Growth' AS growth_category FROM (SELECT acct, "
     f"count(DISTINCT ord) AS total_orders, {mean('amt')} AS avg_order_amt_usd, list(DISTINCT yr) FILTER (WHERE yr IS NOT NULL) AS ys "
     f"FROM buys{_only(sc, inside=SCOPE)} GROUP BY acct) {_NAMED} "
     f"WHERE len(ys) > 1 AND total_orders > {GROWTH_PER_YEAR} * len(ys)")

both("order_gaps", lambda s, r: op.order_gaps(s, r), lambda sc:
     ", days AS (SELECT acct, list_sort(list(ts::DATE)) AS d FROM buys" + _only(sc, "ts IS NOT NULL", inside=SCOPE)
     + " GROUP BY acct HAVING count(*) > 1) SELECT c_name AS account_name, lower(c_name) AS website, "
     "c_mktsegment AS primary_contact, "
     + half_up("list_sum(list_transform(range(2, len(d) + 1), lambda i: d[i] - d[i - 1]))", "len(d) - 1")
     + " AS avg_days_between_orders FROM days JOIN customer ON c_custkey = acct")

both("rep_contribution", lambda s, r: op.rep_contribution(s, r), lambda sc:
     "SELECT reg AS region_name, rep AS sales_representative, count(ord) AS num_orders, "
     f"{usd('sum(amt)')} AS total_amt_usd, {usd('sum(sum(amt)) OVER (PARTITION BY reg)')} AS region_total_amt_usd, "
     + half_up("sum(amt)", "sum(sum(amt)) OVER (PARTITION BY reg)", scale=100, in_scale=2)
     + f" AS contribution_percent_of_region {_SOLD}" + _only(sc, "reg_id IS NOT NULL") + " GROUP BY reg, rep")


def _change(rows: str, order: str, cols: str) -> str:
    """Each account's period beside the one before it, by number."""
    return (f", numbered AS (SELECT *, row_number() OVER (PARTITION BY acct ORDER BY {order}) AS k FROM ({rows})) "
            f"SELECT account_name, {cols} FROM numbered now LEFT JOIN numbered old "
            f"ON old.acct = now.acct AND old.k = now.k - 1 {_NAMED.replace('= acct', '= now.acct')}")


both("quarterly_change", lambda s, r: op.quarterly_change(s, r), lambda sc: _change(
    "SELECT acct, yr, quarter(ts)::BIGINT AS qtr, " + ", ".join(f"sum({p}_qty)::BIGINT AS {p}" for p in _SPLIT)
    + " FROM basket" + _only(sc, inside=SCOPE) + " GROUP BY ALL", "yr NULLS FIRST, qtr NULLS FIRST",
    "now.yr AS order_year, now.qtr AS order_quarter, "
    + ", ".join(f"ifnull(now.{p} - old.{p}, 0) AS quarterly_{p}_qty_growth" for p in _SPLIT)))
both("yearly_change", lambda s, r: op.yearly_change(s, r), lambda sc: _change(
    "SELECT acct, yr, sum(amt) AS total FROM buys" + _only(sc, inside=SCOPE) + " GROUP BY ALL", "yr NULLS FIRST",
    f"now.yr AS order_year, {usd('now.total')} AS total_order_amount, "
    f"if(old.total IS NULL, 0.0::DOUBLE, {usd('now.total - old.total')}) AS year_over_year_order_amount_change"))

both("top_mean_accounts", lambda s, r: op.top_mean_accounts(s, r), lambda sc:
     ", best AS (SELECT acct, mean_amt FROM wallet" + _only(sc, inside=SCOPE) + " QUALIFY mean_amt = max(mean_amt) OVER ()) "
     f"SELECT account_name, mean_amt AS avg_order_amount FROM best {_NAMED}")

both("activity_segments", lambda s, r: op.activity_segments(s, r, cuts=ACTIVITY_CUTS), lambda sc:
     "SELECT reg AS region_name, " + label(("High Activity", "Medium Activity", "Low Activity"),
                                           f"ifnull(n, 0) <= {ACTIVITY_CUTS[0]}", f"ifnull(n, 0) < {ACTIVITY_CUTS[1]}")
     + f" AS activity_segment, {mean('spent')} AS avg_sales {_OWNERS}{_only(sc)} GROUP BY ALL")


# ---- every row: all ranks, all gaps, distinct counts at every grain ----------------------------

both("account_ranks", lambda s, r: op.account_ranks(s, r), lambda sc:
     f"SELECT acct AS account_id, who AS account_name, ifnull(n, 0) AS total_orders, {usd('spent')} AS total_spend, "
     "dense_rank() OVER (ORDER BY ifnull(n, 0) DESC) AS order_rank, "
     f"dense_rank() OVER (ORDER BY spent DESC NULLS LAST) AS spend_rank {_OWNERS}{_only(sc)}")

def _as_text(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})


def _text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


both("order_intervals", lambda s, r: _as_text(op.order_intervals(s, r), "occurred_at", "previous_at"), lambda sc:
     f"SELECT acct AS account_id, ord AS order_id, {_text('ts')} AS occurred_at, {_text('lag(ts) OVER w')} AS previous_at, "
     "date_diff('day', lag(ts) OVER w, ts) AS days FROM buys"
     + _only(sc, "ts IS NOT NULL", "acct IN (SELECT acct FROM people)", inside=SCOPE)
     + " WINDOW w AS (PARTITION BY acct ORDER BY ts, ord)")
both("channel_reach", lambda s, r: op.channel_reach(s, r), lambda sc:
     "SELECT grouping(reg, channel) AS level, reg AS region_name, channel, count(DISTINCT acct) AS accounts "
     "FROM people JOIN clicks USING (acct)" + _only(sc, "reg_id IS NOT NULL")
     + " GROUP BY GROUPING SETS ((reg, channel), (reg), (channel), ()) HAVING count(*) > 0")
both("active_accounts", lambda s, r: op.active_accounts(s, r), lambda sc:
     "SELECT grouping(yr, mon) AS level, yr AS year, mon AS month, count(DISTINCT acct) AS accounts FROM buys"
     + _only(sc, "acct IS NOT NULL", inside=SCOPE) + " GROUP BY GROUPING SETS ((yr, mon), (yr), ()) HAVING count(*) > 0")

# ---- states by account and month, and what is rolled up from them -------------------------------

_STATE_SUMS = ", ".join(
    [f"CAST(sum({p}_qty) AS BIGINT) AS {p}_qty, {usd(f'sum({p}_amt)')} AS {p}_usd" for p in _SPLIT])


def _monthly(star: Star) -> DataFrame:
    made = states.order_states(star)
    return _as_text(made, "first_at", "last_at").select(
        "account_id", "order_year", "order_month", "n", "n_amt", E.usd("cents").alias("total_usd"), E.usd("max_cents").alias("max_usd"),
        F.round(E.deviation("n_amt", "cents", "squares"), 4).alias("std_dev_usd"), "first_at", "last_at",
        *[c for p in _SPLIT for c in (F.col(f"{p}_qty"), E.usd(f"{p}_cents").alias(f"{p}_usd"))])


def _served(star: Star) -> Star:
    return states.with_states(star, states.order_states(star), states.event_states(star))


def _maintained(star: Star) -> Star:
    """The star served from a stored roll-up that was made without the last year and then refreshed with it."""
    spark = star.orders.sparkSession
    path = new_path(spark, "roll-up")
    last = star.orders.agg(F.max(F.year("occurred_at"))).first()[0]
    states.write_states(star.with_orders(lambda o: o.filter((F.col("occurred_at") < F.lit(f"{last}-01-01").cast("timestamp_ntz"))
                                                            | F.col("occurred_at").isNull())) if last else star, path)
    for year in [last] if last else []:
        states.refresh_states(star, path, [year])
    return states.with_states(star, states.read_states(spark, path))


register("monthly_states", _monthly, _q(
    f"SELECT acct AS account_id, yr AS order_year, mon AS order_month, count(ord) AS n, count(amt) AS n_amt, {usd('sum(amt)')} AS total_usd, "
    f"{usd('max(amt)')} AS max_usd, round(stddev_samp(amt::DOUBLE), 4) AS std_dev_usd, {_text('min(ts)')} AS first_at, {_text('max(ts)')} AS last_at, {_STATE_SUMS} "
    "FROM basket GROUP BY acct, yr, mon"))


def _level_totals(star: Star, region: str | None) -> DataFrame:
    s = scope_region(_served(star), region)
    by_period = states.period_totals(s).select(
        F.lit("period").alias("kind"), "level", F.lit(None).cast("string").alias("region_name"), F.lit(None).cast("string").alias("rep_name"),
        "year", "month", "n", "cents")
    none = F.lit(None).cast("long")
    by_territory = states.territory_totals(s).select(F.lit("territory").alias("kind"), "level", "region_name", "rep_name",
                                                     none.alias("year"), none.alias("month"), "n", "cents")
    return by_period.unionAll(by_territory).select("kind", F.col("level").cast("long").alias("level"), "region_name", "rep_name", "year", "month",
                                                   F.col("n").alias("orders"), E.usd("cents").alias("total_usd"))


both("rolled_up_totals", _level_totals, lambda sc:
     f"SELECT 'period' AS kind, grouping(yr, mon) AS level, NULL::VARCHAR AS region_name, NULL::VARCHAR AS rep_name, yr AS year, mon AS month, "
     f"count(ord) AS orders, {usd('sum(amt)')} AS total_usd FROM buys" + _only(sc, inside=SCOPE) + " GROUP BY GROUPING SETS ((yr, mon), (yr), (mon)) "
     f"UNION ALL SELECT 'territory', grouping(reg, rep), reg, rep, NULL, NULL, count(ord), {usd('sum(amt)')} {_SOLD}"
     + _only(sc, "reg_id IS NOT NULL") + " GROUP BY GROUPING SETS ((reg, rep), (reg))")
register("maintained_sales_by_year", lambda s: op.sales_by_year(_maintained(s)), ENTRIES["sales_by_year"][1])
register("maintained_lifetime_value", lambda s: op.lifetime_value(_maintained(s)), ENTRIES["lifetime_value"][1])

# ---- driver-facing views --------------------------------------------------------------------

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Star.from_testdata(spark, sf_dir)))
            for name, (fn, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql is not None}
