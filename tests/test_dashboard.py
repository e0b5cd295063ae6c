"""The one-call dashboard equals the individual analyses, scoped and unscoped."""

from __future__ import annotations

import pytest

from meridian import operators as op
from meridian import registry
from meridian.operators.dashboard import datasets
from meridian.sources.star import Star

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("region", [None, "ASIA"])
def test_dashboard_equals_direct_calls(spark, region):
    star = Star.from_testdata(spark, SF_DIR)
    kw = dict(years=registry.YEARS, min_standard=registry.MIN_STANDARD,
              min_poster=registry.MIN_POSTER, volume_cuts=registry.VOLUME_CUTS,
              value_cut=registry.VALUE_CUT, channels=registry.CHANNELS)
    ds = datasets(star, region, **kw)
    direct = {
        "headline_sales": op.headline_sales(star, region),
        "rep_channel_matrix": op.rep_channel_matrix(star, region, registry.CHANNELS),
        "channel_effectiveness": op.channel_effectiveness(star, region),
        "region_channel": op.region_channel(star, region),
        "rank_segments": op.rank_segments(star, region),
        "activity_segments": op.activity_segments(star, region),
        "sales_by_month": op.sales_by_month(star, region, years=registry.YEARS, detail=True),
        "volume_value_segments": op.volume_value_segments(
            star, region, cuts=registry.VOLUME_CUTS, value_cut=registry.VALUE_CUT),
    }
    assert len(ds) == 20
    for name, df in direct.items():
        assert sorted(ds[name].collect()) == sorted(df.collect()), name
    for name, df in ds.items():
        df.write.format("noop").mode("overwrite").save()


def test_cached_dimensions(spark):
    star = Star.from_testdata(spark, SF_DIR)
    cached = star.cache_dimensions()
    try:
        assert cached.region.is_cached and cached.sales_reps.is_cached
        assert cached.accounts.is_cached  # 1,500 accounts: within the bound
        assert not cached.orders.is_cached
        assert sorted(op.sales_by_region(cached).collect()) == sorted(
            op.sales_by_region(star).collect())
    finally:
        cached.unpersist()
    big = Star.from_testdata(spark, SF_DIR, broadcast_rows=100).cache_dimensions()
    try:
        assert big.region.is_cached and not big.accounts.is_cached
    finally:
        big.unpersist()


def test_command_line_writes_every_dataset(spark, tmp_path):
    from meridian.__main__ import main
    from tests.fixture import build
    src = tmp_path / "src"
    src.mkdir()
    build(str(src))
    Star.from_testdata(spark, str(src)).write_tables(str(tmp_path / "star"))
    main(["--tables", str(tmp_path / "star"), "--region", "ASIA", "--out", str(tmp_path / "out")])
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert len(names) == 20 and "headline_sales" in names
    head = spark.read.parquet(str(tmp_path / "out" / "headline_sales")).collect()
    assert len(head) == 1 and head[0]["total_sales"] > 0
