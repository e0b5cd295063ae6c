"""Customer segmentation and cohorts: rank, volume, value, activity segments and retention.

All of them reduce orders to one row per account first and then label / group accounts;
no analysis sends all accounts through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import exprs as E
from meridian.plans.scope import account_dim, scope_region
from meridian.plans.states import account_totals
from meridian.sources.star import Star

# Segment labels.
ORDER_ACTIVITY = ("Highly Active", "Moderately Active", "Less Active")
SPENDING = ("High Spender", "Moderate Spender", "Low Spender")
VOLUME = ("High Volume", "Moderate Volume", "Low Volume")
VALUE = ("High Value", "Low Value")
ACTIVITY = ("High Activity", "Medium Activity", "Low Activity")


def _accounts_with_orders(s: Star, dim: DataFrame, **extra: Column) -> DataFrame:
    """Every account of ``dim`` LEFT JOIN its per-account order aggregate (the left join
    restricts to the scope; orders are filtered earlier only where that is map-side)."""
    per = account_totals(s).select("account_id", "n", F.col("cents").alias("spent"), "n_amt",
                                   *[v.alias(k) for k, v in extra.items()])
    return dim.join(per, "account_id", "left").withColumn(
        "total_orders", F.coalesce("n", F.lit(0).cast("long")))


def _plain_accounts(s: Star) -> DataFrame:
    return s.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))


def _top_ranks(df: DataFrame, cols: list[str], k: int) -> list[DataFrame]:
    """For each column ``cols[i]`` its ``k`` largest distinct values ``_v{i}`` with their dense rank
    ``_rank{i}`` (NULL is one value, ranked last): at most ``k`` rows.

    The values of all columns are stacked as (column index, value) pairs and de-duplicated in one
    distributed aggregate, which the columns share; each is then a top-k, in which a task
    sends at most k values, whatever k is, and only those k rows are numbered."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), F.col(c).cast("decimal(38,0)").alias("_v"))
        for i, c in enumerate(cols)]))).distinct()
    order = F.col("_v").desc_nulls_last()
    return [pairs.filter(F.col("_m") == i).orderBy(order).limit(k)
            .select(F.col("_v").alias(f"_v{i}"),
                    F.row_number().over(Window.partitionBy("_m").orderBy(order)).alias(f"_rank{i}"))
            for i in range(len(cols))]


def _attach_rank(s: Star, df: DataFrame, top: DataFrame, i: int, c: str, k: int) -> DataFrame:
    """``df`` with ``_rank{i}`` of its column ``c``; the ranks are broadcast if so many rows may be."""
    top = F.broadcast(top) if k <= s.broadcast_rows else top
    return df.join(top, F.col(c).cast("decimal(38,0)").eqNullSafe(top[f"_v{i}"]), "left").drop(f"_v{i}")


def _rank_label(rank: str, cuts: tuple[int, int], labels: tuple[str, str, str]) -> Column:
    return E.label_by_cuts([(F.col(rank) <= cuts[0], labels[0]),
                            (F.col(rank) <= cuts[1], labels[1])], labels[2])


def rank_segments(star: Star, region: str | None = None,
                  cuts: tuple[int, int] = (3, 10)) -> DataFrame:
    """Label accounts by the dense rank of their order count and of their spend (all accounts
    of the scope; ranks are taken inside the scope).

    Only ranks up to ``max(cuts)`` matter, so instead of a global window (one task holding
    every account) the top distinct values are found with a distributed top-k, numbered, and
    broadcast back; every other account gets the last label. The per-account summary feeds
    both the ranking branch and the output through the same orders exchange, which Spark
    reuses, so orders are scanned and shuffled once."""
    s = scope_region(star, region)
    base = _accounts_with_orders(s, _plain_accounts(s))
    measures, k = ["total_orders", "spent"], max(cuts)
    ranked = base
    for i, top in enumerate(_top_ranks(base, measures, k)):
        ranked = _attach_rank(s, ranked, top, i, measures[i], k)
    return (ranked.select(
        "account_name", "total_orders", E.usd("spent").alias("total_spend"),
        _rank_label("_rank0", cuts, ORDER_ACTIVITY).alias("order_activity_segment"),
        _rank_label("_rank1", cuts, SPENDING).alias("spending_segment"),
        "spent", "account_id")
        .orderBy(F.col("total_orders").desc(), F.col("spent").desc_nulls_last(), "account_name",
                 "account_id")
        .drop("spent", "account_id"))


def cohort_retention(star: Star, region: str | None = None) -> DataFrame:
    """Per year of first order: accounts, accounts that ordered again in a later year, accounts
    that ordered in the first year, and retention in percent (2 dp, exact).

    An account is retained iff the year of its last order is after that of its first, so one
    min/max aggregate per account replaces the join of first orders back to all orders."""
    s = scope_region(star, region)
    per = account_totals(s, restrict=True).select("account_id", F.col("first_at").alias("lo"), F.col("last_at").alias("hi"))
    out = per.groupBy(E.year("lo").alias("first_order_year")).agg(
        F.count("account_id").alias("total_customers"),
        F.count(F.when(E.year("hi") > E.year("lo"), F.col("account_id")))
        .alias("retained_customers"),
        F.count(F.when(F.col("lo").isNotNull(), F.col("account_id"))).alias("new_customers"))
    return (out.withColumn("retention_rate",
                           E.percent("retained_customers", "total_customers"))
            .orderBy(F.col("first_order_year").asc_nulls_last()))


def _stats(s: Star, ddof: int) -> DataFrame:
    base = _accounts_with_orders(s, _plain_accounts(s), std=E.deviation("n_amt", "cents", "squares", ddof))
    return base.select("account_id", "total_orders", "spent", E.mean("spent", "n_amt").alias("avg_amt"), "std")


def _volume(cuts: tuple[int, int]) -> Column:
    return E.label_by_cuts([(F.col("total_orders") > cuts[0], VOLUME[0]),
                            (F.col("total_orders") > cuts[1], VOLUME[1])], VOLUME[2])


def _segment_aggs() -> list[Column]:
    # Means of the accounts' means and deviations, added exactly; rounded to 4 dp at the end.
    return [F.count("account_id").alias("num_accounts"),
            E.exact_mean("avg_amt").alias("avg_order_size_usd"),
            E.exact_mean("std").alias("avg_order_std_dev_usd")]


def volume_segments(star: Star, region: str | None = None, cuts: tuple[int, int] = (50, 10),
                    ddof: int = 1) -> DataFrame:
    """Accounts by order count (> cuts[0] High, > cuts[1] Moderate, else Low Volume):
    accounts, mean of the account mean orders, mean of the account order deviations."""
    s = scope_region(star, region)
    st = _stats(s, ddof).withColumn("order_volume_segment", _volume(cuts))
    return (st.groupBy("order_volume_segment").agg(*_segment_aggs())
            .orderBy(F.col("num_accounts").desc(), "order_volume_segment"))


def volume_value_segments(star: Star, region: str | None = None,
                          cuts: tuple[int, int] = (50, 10), value_cut: float = 1000,
                          ddof: int = 1) -> DataFrame:
    """Volume segments crossed with value segments (mean order > ``value_cut`` High Value,
    else, also without orders, Low Value), plus the segment's total sales."""
    s = scope_region(star, region)
    value = E.label_by_cuts([(F.col("avg_amt") > value_cut, VALUE[0])], VALUE[1])
    st = (_stats(s, ddof).withColumn("order_volume_segment", _volume(cuts))
          .withColumn("order_value_segment", value))
    return (st.groupBy("order_volume_segment", "order_value_segment")
            .agg(*_segment_aggs(), E.usd(E.merge_cents("spent")).alias("total_sales_in_segment"))
            .orderBy(F.col("num_accounts").desc(), "order_volume_segment", "order_value_segment"))


def activity_segments(star: Star, region: str | None = None,
                      cuts: tuple[int, int] = (20, 10)) -> DataFrame:
    """Mean account sales per (region name, activity): more than cuts[0] orders High, from
    cuts[1] to cuts[0] inclusive Medium, else Low Activity. Accounts without sales are in no
    mean but still form their group; unscoped, accounts without a region group under NULL."""
    s = scope_region(star, region)
    dim = account_dim(s, "left" if s.scope is None else "inner").select("account_id",
                                                                         "region_name")
    base = _accounts_with_orders(s, dim)
    seg = E.label_by_cuts([(F.col("total_orders") > cuts[0], ACTIVITY[0]),
                           (F.col("total_orders").between(cuts[1], cuts[0]), ACTIVITY[1])],
                          ACTIVITY[2])
    return (base.withColumn("activity_segment", seg)
            .groupBy("region_name", "activity_segment")
            .agg(E.mean(E.merge_cents("spent"), F.count("spent")).alias("avg_sales"))
            .orderBy(F.col("region_name").asc_nulls_last(), F.col("avg_sales").desc_nulls_last(),
                     "activity_segment"))
