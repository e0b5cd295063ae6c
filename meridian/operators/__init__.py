"""The analyses. Each is ``f(star, region=None, **params) -> DataFrame``."""

from meridian.operators.accounts import (account_roster, accounts_per_rep, churn, high_growth,
                                         lifetime_value, order_gaps, region_catalog,
                                         rep_acquisition, top_mean_accounts)
from meridian.operators.channels import (channel_effectiveness, region_channel,
                                         rep_channel_counts, rep_channel_matrix)
from meridian.operators.sales import (best_month, headline_sales, mean_order_by_region,
                                      mean_product_amounts, quarterly_change, rep_contribution,
                                      sales_by_month, sales_by_region, sales_by_year,
                                      sales_on_day, sales_year_extremes, seasonality,
                                      unit_prices, yearly_change)
from meridian.operators.segments import (activity_segments, cohort_retention, rank_segments,
                                         volume_segments, volume_value_segments)
from meridian.operators.sequences import (account_ranks, active_accounts, channel_reach,
                                          order_intervals)

__all__ = [
    "region_catalog", "account_roster", "accounts_per_rep", "unit_prices",
    "mean_product_amounts", "rep_channel_counts", "rep_channel_matrix", "sales_by_year",
    "sales_year_extremes", "sales_by_month", "sales_on_day", "best_month", "sales_by_region",
    "headline_sales", "lifetime_value", "channel_effectiveness", "rep_acquisition", "churn",
    "seasonality", "mean_order_by_region", "region_channel", "rank_segments",
    "cohort_retention", "volume_segments", "volume_value_segments", "high_growth",
    "order_gaps", "rep_contribution", "quarterly_change", "yearly_change",
    "top_mean_accounts", "activity_segments", "account_ranks", "active_accounts", "channel_reach",
    "order_intervals",
]
