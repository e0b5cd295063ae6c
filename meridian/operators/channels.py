"""Web-event channel analyses.

Events are rolled up through the account dimension with :func:`meridian.plans.scope.rollup`:
broadcast-and-aggregate when the accounts are proven few, else pre-aggregate per
(account, channel) and join the per-account rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.plans.scope import account_dim, account_ids, scope_region, small
from meridian.plans.states import event_totals
from meridian.sources.star import Star


def rep_channel_counts(star: Star, region: str | None = None) -> DataFrame:
    """Events per (rep name, channel), for events whose account has a rep; most first."""
    s = scope_region(star, region)
    acc = s.accounts.select(F.col("id").alias("account_id"), F.col("sales_rep_id").alias("rep_id"))
    reps = s.sales_reps.select(F.col("id").alias("rep_id"), F.col("name").alias("sales_rep_name"))
    dim = acc.join(small(s, "sales_reps", reps), "rep_id").drop("rep_id")
    out = event_totals(s, dim, ["sales_rep_name", "channel"],
                 {"number_of_occurrences": ("count", "one")})
    return out.orderBy(F.col("number_of_occurrences").desc(), "sales_rep_name", "channel")


def rep_channel_matrix(star: Star, region: str | None = None,
                       channels: Sequence[str] | None = None, other: str = "other") -> DataFrame:
    """Rep name x channel event counts as a wide table, absent pairs 0.

    Without ``channels`` every channel found is a column, whatever its name: the distinct names are read
    first, in a job of its own whose result is one row a channel. Events without a channel come under ``null``;
    a name that is taken already (names differing in case only are one to Spark, ``sales_rep_name`` is the
    first column) gets ``_2``, ``_3`` and so on behind it. With a list the columns are fixed and all
    other events are counted under ``other``, so that a row always sums to the rep's events."""
    counts = rep_channel_counts(star, region)
    if channels is not None:
        listed = F.col("channel").isin(*channels) if channels else F.lit(False)
        counts = counts.withColumn("channel", F.when(listed, F.col("channel")).otherwise(F.lit(other)))
        found = [*channels, *([] if other in channels else [other])]
    else:
        found = [r[0] for r in counts.select("channel").distinct().collect()]  # one row a channel
        found = sorted(found, key=lambda c: (c is None, c))
    taken, columns = {"sales_rep_name"}, []
    for c in found:
        base = name = "null" if c is None else c
        k = 1
        while name.lower() in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name.lower())
        one = F.when(F.col("channel").eqNullSafe(F.lit(c)), F.col("number_of_occurrences"))
        columns.append(F.coalesce(F.sum(one), F.lit(0)).alias(name))
    # without any event there is no channel and no row
    wide = counts.groupBy("sales_rep_name")
    return (wide.agg(*columns) if columns else wide.agg(F.lit(0)).select("sales_rep_name")).orderBy("sales_rep_name")


def channel_effectiveness(star: Star, region: str | None = None) -> DataFrame:
    """Per channel: events, distinct event account ids, distinct matched accounts.

    Unscoped, events whose account is unknown still count (in the first two); scoped, only
    events of the region's accounts count."""
    s = scope_region(star, region)
    how = "left" if s.scope is None else "inner"
    out = event_totals(s, account_ids(s), ["channel"],
                 {"total_events": ("count", "id")}, how=how,
                 accounts_as="total_customers", fact_accounts_as="unique_accounts")
    return (out.select("channel", "total_events", "unique_accounts", "total_customers")
            .orderBy(F.col("total_events").desc(), "channel"))


def region_channel(star: Star, region: str | None = None) -> DataFrame:
    """Events and distinct matched accounts per (region name, channel). Unscoped, events
    without a region form a NULL-region group; scoped, only the region's events count."""
    s = scope_region(star, region)
    how = "left" if s.scope is None else "inner"
    dim = account_dim(s, how).select("account_id", "region_name")
    out = event_totals(s, dim, ["region_name", "channel"],
                 {"total_events": ("count", "id")}, how=how,
                 accounts_as="unique_accounts_impacted")
    return out.orderBy(F.col("region_name").asc_nulls_last(), F.col("total_events").desc(),
                       "channel")
