"""All datasets of the region dashboard in one call, from one pass over the facts.

``datasets(star, region)`` returns the DataFrames behind every chart of the page for one region (``None`` =
all regions), with the page's parameters as defaults. The orders are read once, into states
by account and month (see meridian.plans.states), the events once, into counts by account and channel. All
datasets but the price list, which has a row an order, are rolled up from these: the periods and the
territories each by one pass of grouping sets, the account datasets from one table of accounts.

The shared tables are persisted, and filled by the first dataset that is read; ``close()`` of the result frees them.
A star that has states already (``states.with_states``, from a maintained roll-up) is not scanned at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from meridian.operators import accounts as A
from meridian.operators import channels as C
from meridian.operators import sales as S
from meridian.operators import segments as G
from meridian.plans import states as T
from meridian.plans.scope import scope_region
from meridian.sources.star import Star


class Datasets(dict):
    """Name to DataFrame, and the persisted tables that they share."""

    def __init__(self, shared: list[DataFrame], found: dict[str, DataFrame]):
        super().__init__(found)
        self.shared = shared

    def close(self) -> None:
        for df in self.shared:
            df.unpersist()


def one_pass(star: Star, region: str | None = None) -> tuple[Star, list[DataFrame]]:
    """The scoped star with states in place of its facts, and the tables that its analyses share, persisted."""
    s = scope_region(star, region)
    orders = T.order_states(s) if s.order_states is None else s.order_states
    events = T.event_states(s) if s.event_states is None else s.event_states
    s = T.with_states(s, orders, events)
    shared = [orders, events, T.account_totals(s), T.period_totals(s), T.territory_totals(s)]
    for df in shared:
        df.persist(StorageLevel.MEMORY_AND_DISK)  # a lost block is computed again
    return s, shared


def datasets(star: Star, region: str | None = None, *, years: Iterable[int] = (2013, 2017),
             min_standard: float = 100, min_poster: float = 50,
             volume_cuts: tuple[int, int] = (50, 10), value_cut: float = 1000,
             rank_cuts: tuple[int, int] = (3, 10), activity_cuts: tuple[int, int] = (20, 10),
             channels: Sequence[str] | None = None) -> Datasets:
    s, shared = one_pass(star, region)
    # the scoped star is passed on with region=None: it is already narrowed
    return Datasets(shared, {
        "regions": A.region_catalog(star),
        "headline_sales": S.headline_sales(s),
        "accounts_per_rep": A.accounts_per_rep(s),
        "rep_channel_matrix": C.rep_channel_matrix(s, channels=channels),
        "rep_acquisition": A.rep_acquisition(s),
        "mean_order_by_region": S.mean_order_by_region(s, formatted=True),
        "volume_value_segments": G.volume_value_segments(s, cuts=volume_cuts,
                                                         value_cut=value_cut),
        "unit_prices": S.unit_prices(s, min_standard=min_standard, min_poster=min_poster,
                                     with_region=False),
        "sales_by_year": S.sales_by_year(s),
        "sales_year_extremes": S.sales_year_extremes(s),
        "lifetime_value": A.lifetime_value(s, marker=True),
        "churn": A.churn(s),
        "region_channel": C.region_channel(s),
        "rep_contribution": S.rep_contribution(s),
        "sales_by_month": S.sales_by_month(s, years=years, detail=True),
        "mean_product_amounts": S.mean_product_amounts(s),
        "channel_effectiveness": C.channel_effectiveness(s),
        "seasonality": S.seasonality(s, names=True),
        "rank_segments": G.rank_segments(s, cuts=rank_cuts),
        "activity_segments": G.activity_segments(s, cuts=activity_cuts),
    })
