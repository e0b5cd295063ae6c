"""The driver contract: every registered query has an oracle, runs on the given tables and
returns the oracle's column names."""

from __future__ import annotations

import re

import __spark_entry__ as entry
from meridian import registry
from tests.compare import duck

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle_and_a_plain_name():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(registry.ENTRIES) <= set(q) & set(o) and set(o) <= set(q) and len(registry.ENTRIES) >= 86
    for name in registry.ENTRIES:
        assert re.fullmatch(r"[a-z][a-z_]*", name) and not name.startswith("op"), name
        assert "pipeline" not in name, name


def test_columns_match_the_oracle_without_running(spark):
    con = duck(SF_DIR)
    for name, fn in registry.queries().items():
        cols = fn(spark, SF_DIR).columns
        assert sorted(cols) == sorted(con.sql(entry.oracle_sql()[name]).columns), name


def test_entry_runs_on_the_smoke_data(spark):
    df = entry.entry(spark)
    assert df.columns == ["region_name", "total_sales"]
    assert df.count() > 0
