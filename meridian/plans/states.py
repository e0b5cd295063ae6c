"""Mergeable partial states of the orders and events, from which the analyses can be rolled up.

``order_states`` reads the orders once and leaves one row an account and month: counts, exact sums and sums of
squares in cents, first and last times, largest amount, and the product split. Every measure merges (sum, min
or max), so any coarser grain comes from these rows without the orders. A star that carries
them (``with_states``) serves its analyses from them.

Stored by year (``write_states``), they are a maintained roll-up: ``refresh_states`` reads the orders of the
changed years only and replaces just these partitions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType, TimestampNTZType

from meridian.functions import exprs as E
from meridian.plans.scope import account_dim, account_ids, accounts_fit, early_scope, rollup
from meridian.plans.scratch import stored
from meridian.sources.star import ORDER_YEAR, PRODUCTS, Star

_COUNTS = ["n", "n_timed", "n_amt", *[f"{p}_n" for p in PRODUCTS], *[f"{p}_qty" for p in PRODUCTS]]
_CENTS = ["cents", *[f"{p}_cents" for p in PRODUCTS]]
#: Name of a measure to the aggregate that merges it.
MERGE = {**{c: F.sum for c in _COUNTS}, **{c: E.merge_cents for c in _CENTS}, "squares": F.sum,
         "max_cents": F.max, "first_at": F.min, "last_at": F.max}

#: A stored state row, without the year, which is the partition.
SCHEMA = StructType([StructField("account_id", LongType()), StructField("order_month", LongType()),
                     *[StructField(c, LongType()) for c in _COUNTS],
                     *[StructField(c, DecimalType(28, 0)) for c in _CENTS],
                     StructField("squares", DecimalType(38, 0)), StructField("max_cents", LongType()),
                     StructField("first_at", TimestampNTZType()), StructField("last_at", TimestampNTZType())])
_YEAR = StructField(ORDER_YEAR, LongType())


def _measures(products: bool) -> list:
    found = [F.count("id").alias("n"), F.count("occurred_at").alias("n_timed"), F.count("total_amt_usd").alias("n_amt"),
             E.money_sum("total_amt_usd").alias("cents"), E.square_sum("total_amt_usd").alias("squares"),
             F.max(E.cents("total_amt_usd")).alias("max_cents"),
             F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")]
    for p in PRODUCTS if products else ():
        found += [F.sum(f"{p}_qty").cast("long").alias(f"{p}_qty"), E.money_sum(f"{p}_amt_usd").alias(f"{p}_cents"),
                  F.count(f"{p}_amt_usd").alias(f"{p}_n")]
    return found


def order_states(star: Star) -> DataFrame:
    """One row per (account_id, order_year, order_month) of the star's orders, those without an account or a
    time included, with all measures of SCHEMA: one scan, one aggregate with partial sums in each task.

    A scope's accounts restrict the orders first where that is a map-side filter."""
    o = early_scope(star, star.detailed_orders)
    o = o.drop(ORDER_YEAR).withColumns({ORDER_YEAR: E.year("occurred_at"), "order_month": E.month("occurred_at")})
    made = o.groupBy("account_id", ORDER_YEAR, "order_month").agg(*_measures(products=True))
    return made.select(*[F.col(f.name).cast(f.dataType) for f in [*SCHEMA.fields, _YEAR]])


def event_states(star: Star) -> DataFrame:
    """One row per (account_id, channel) of the events: ``n`` with an id and ``one`` in all."""
    return early_scope(star, star.web_events).groupBy("account_id", "channel").agg(
        F.count("id").alias("id"), F.count(F.lit(1)).alias("one"))


def with_states(star: Star, orders: DataFrame | None = None, events: DataFrame | None = None) -> Star:
    """The star with states that its analyses are served from, in place of its orders and events."""
    return replace(star, order_states=orders, event_states=events, _memo={})


def merged(states: DataFrame, *keys) -> DataFrame:
    """States merged to a coarser grain."""
    return states.groupBy(*keys).agg(*[f(c).alias(c) for c, f in MERGE.items()])


# ---- what the analyses read ------------------------------------------------------------------

def account_totals(s: Star, *periods: str, products: bool = False, restrict: bool = False) -> DataFrame:
    """One row per (account_id, *periods), periods of ``order_year`` and ``order_quarter``, with the measures.

    From the star's states or, without them, from its orders; unused measures are pruned. Scoped, rows of
    other accounts may be left, as a later join with the scope's accounts restricts them; ``restrict`` does it here."""
    if s.order_states is not None:
        states = s.order_states
        if "order_quarter" in periods:
            states = states.withColumn("order_quarter", F.expr("(order_month + 2) div 3"))
        out = s.memo(("account_totals", periods), lambda: merged(states, "account_id", *periods))
    else:
        o = early_scope(s, s.detailed_orders if products else s.orders)
        made = {ORDER_YEAR: E.year("occurred_at"), "order_quarter": E.quarter("occurred_at")}
        o = o.drop(ORDER_YEAR).withColumns({k: made[k] for k in periods}) if periods else o
        out = o.groupBy("account_id", *periods).agg(*_measures(products))
    if restrict and s.scope is not None and not (s.order_states is None and accounts_fit(s)):
        ids = account_ids(s)
        out = out.join(F.broadcast(ids) if accounts_fit(s) else ids, "account_id", "left_semi")
    return out


#: Grouping ids of (year, month) in ``period_totals`` and of (region, representative) in ``territory_totals``.
YEAR_MONTH, YEAR, MONTH = 0, 1, 2
REP, REGION = 0, 1


def period_totals(s: Star) -> DataFrame:
    """(level, year, month, n, n_amt, cents, max_cents) of a star with states: by year and month, by year and by
    calendar month over all years, in one pass of grouping sets. Unscoped every order counts, scoped
    those of the scope's accounts."""
    def build() -> DataFrame:
        states = s.order_states
        if s.scope is not None:
            ids = account_ids(s)
            states = states.join(F.broadcast(ids) if accounts_fit(s) else ids, "account_id")
        states = states.withColumns({"year": F.col(ORDER_YEAR), "month": F.col("order_month")})
        y, m = F.col("year"), F.col("month")
        return states.groupingSets([[y, m], [y], [m]], y, m).agg(
            F.grouping_id().alias("level"), *[MERGE[c](c).alias(c) for c in ("n", "n_amt", "cents", "max_cents")])

    return s.memo(("period_totals",), build)


def territory_totals(s: Star) -> DataFrame:
    """(level, region_name, rep_name, n, n_amt, cents) of a star with states, for accounts with a representative in
    a region: by region and representative name, and by region, in one pass of grouping sets."""
    def build() -> DataFrame:
        dim = account_dim(s, "inner").select("account_id", "region_name", "rep_name")
        rows = account_totals(s).select("account_id", "n", "n_amt", "cents")
        rows = rows.join(F.broadcast(dim) if accounts_fit(s) else dim, "account_id")
        g, r = F.col("region_name"), F.col("rep_name")
        return rows.groupingSets([[g, r], [g]], g, r).agg(
            F.grouping_id().alias("level"), *[MERGE[c](c).alias(c) for c in ("n", "n_amt", "cents")])

    return s.memo(("territory_totals",), build)


def event_totals(s: Star, dim: DataFrame, by: list[str], measures: dict, **kw) -> DataFrame:
    """Events rolled up through an account dimension (see ``rollup``), from the star's states or its events."""
    if s.event_states is not None:
        return rollup(s, s.event_states, dim, by, measures, states=True, **kw)
    events = s.web_events.select("id", "account_id", "channel", F.lit(1).alias("one"))
    return rollup(s, events, dim, by, measures, **kw)


# ---- the maintained roll-up --------------------------------------------------------------------

def write_states(star: Star, path: str) -> None:
    """The states of all orders under ``path``, by ``order_year``; replaces what is there."""
    order_states(star).write.mode("overwrite").partitionBy(ORDER_YEAR).parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType([*SCHEMA.fields, _YEAR])).parquet(path)


def _of_years(star: Star, years: Iterable[int | None]) -> Star:
    """Orders of these years; None are those without a time."""
    timed = sorted({y for y in years if y is not None})
    untimed = None in set(years)

    def narrow(df: DataFrame) -> DataFrame:
        cond = E.in_years(df, "occurred_at", timed)
        if untimed:  # their partition has no year either
            cond = cond | (F.col(ORDER_YEAR).isNull() if ORDER_YEAR in df.columns else F.col("occurred_at").isNull())
        return df.filter(cond)

    return star.with_orders(narrow)


def refresh_states(star: Star, path: str, years: Iterable[int | None]) -> None:
    """Bring the stored states of ``years`` (None: orders without a time) up to date: only the orders of these years
    are read, and only their partitions are replaced. A year without orders any more loses its partition.

    The new states are written aside first, then staged and put in place when the job commits; lost executors cost
    tasks only, and a run that is ended may be run again."""
    years = list(years)
    spark = star.orders.sparkSession
    made = stored(order_states(_of_years(star, years)), "states")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ORDER_YEAR).parquet(path)
    before = {r[0] for r in read_states(spark, path).where(_year_in(years)).select(ORDER_YEAR).distinct().collect()}
    now = {r[0] for r in made.select(ORDER_YEAR).distinct().collect()}  # a row a year
    jvm = spark._jvm
    for gone in before - now:
        name = "__HIVE_DEFAULT_PARTITION__" if gone is None else gone
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{ORDER_YEAR}={name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _year_in(years: list[int | None]):
    cond = F.col(ORDER_YEAR).isin([y for y in years if y is not None])
    return cond | F.col(ORDER_YEAR).isNull() if None in years else cond


def changed_years(star: Star, path: str) -> list[int | None]:
    """Years whose number of orders differs from the stored states': what to refresh after orders came or went.
    Both sides read counts by year only. Orders changed in place keep their number, so name their years yourself."""
    year = F.col(ORDER_YEAR).cast("long") if ORDER_YEAR in star.orders.columns else E.year("occurred_at")
    now = star.orders.groupBy(year.alias("year")).agg(F.count("id").alias("now"))
    then = read_states(star.orders.sparkSession, path).groupBy(F.col(ORDER_YEAR).alias("year")).agg(F.sum("n").alias("then"))
    both = now.join(then, now["year"].eqNullSafe(then["year"]), "full")
    differ = both.where(~F.col("now").eqNullSafe(F.col("then"))).select(F.coalesce(now["year"], then["year"]).alias("year"))
    return sorted((r["year"] for r in differ.collect()), key=lambda y: (y is None, y or 0))  # a row a year
