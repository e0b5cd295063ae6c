"""Split joins, full ranks, gaps over range borders, bitmaps: results and plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from meridian import operators as op
from meridian.plans import bitmaps, ranks, skew
from meridian.sources.star import Star
from tests.random_star import build
from tests.test_plans import executed_plan


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def no_help(spark):
    """Neither adaptive execution nor automatic broadcasts."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("hotseq")
    build(str(d), 9, hot=True)
    return str(d)


def test_split_join_equals_the_plain_join(no_help):
    left = no_help.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 90).alias("k"), "id")
    right = no_help.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert skew.hot_keys(left, "k", 0.2) == [7] and skew.hot_keys(left.limit(0), "k") == []
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.split_join(left, right, "k", ["id"], how)) == rows(left.join(right, "k", how))
        assert rows(skew.split_join(left.limit(0), right, "k", ["id"], how)) == []
    with pytest.raises(ValueError):
        skew.split_join(left, right, "k", ["id"], "right")


def test_no_task_of_a_split_join_holds_a_hot_key(no_help):
    left = no_help.range(8000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = no_help.range(8000).select(F.col("id").alias("k"), F.lit(1).alias("v"))

    def largest(df):  # of the tasks' rows after the join
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) / df.count()

    assert largest(left.join(right, "k")) > 0.4
    assert largest(skew.split_join(left, right, "k", ["id"])) < 0.2


def test_unit_prices_of_a_hot_account_are_split(no_help, hot):
    star = Star.from_testdata(no_help, hot, broadcast_rows=0)
    got = op.unit_prices(star, min_standard=-1)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 0.3 * got.count()  # the account holds a third
    assert rows(got) == rows(op.unit_prices(Star.from_testdata(no_help, hot), min_standard=-1))


def test_dense_ranks(spark):
    values = [None, 5.5, 5.5, -1.0, 0.0, 3.25, None, 7.0, 1e300] + [float(i % 50) for i in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    distinct = sorted({v for v in values if v is not None}, reverse=True)
    want = {v: k + 1 for k, v in enumerate(distinct)} | {None: len(distinct) + 1}
    got = ranks.with_dense_rank(df, "v", "r", ["id"]).collect()
    assert len(got) == len(values) and all(x["r"] == want[x["v"]] for x in got)
    assert ranks.with_dense_rank(df.limit(0), "v", "r", ["id"]).collect() == []
    only = ranks.with_dense_rank(df.where("v is null"), "v", "r", ["id"]).collect()
    assert [x["r"] for x in only] == [1, 1]


def test_ranks_send_no_accounts_to_one_task(no_help, hot):
    plan = op.account_ranks(Star.from_testdata(no_help, hot, broadcast_rows=0))._jdf.queryExecution().executedPlan().toString()
    # what is gathered in one task is a count for each range, or one maximum a task; no window orders accounts alone
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert re.match(r"[^\n]*\n[^\n]*HashAggregate\(keys=\[(_r#|\], functions=\[partial_max)", part), part[:300]
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("share", [0.01, 0.9])
def test_previous_rows_cross_the_borders(spark, share):
    base = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"), "id",
        F.when(F.col("id") % 97 > 0, F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(id * 7 % 300)")).alias("at"))
    got = {r["id"]: r["p"] for r in ranks.with_previous(base, "k", "at", "id", "p", share).collect()}
    want, last = {}, {}
    for r in sorted((r for r in base.collect() if r["k"] is not None and r["at"] is not None), key=lambda r: (r["at"], r["id"])):
        want[r["id"]] = last.get(r["k"])
        last[r["k"]] = r["at"]
    assert got == want
    assert ranks.with_previous(base.limit(0), "k", "at", "id", "p").collect() == []


def test_no_window_holds_a_hot_account(no_help, hot):
    star = Star.from_testdata(no_help, hot, broadcast_rows=0)
    orders = star.orders.select("account_id", "id", "occurred_at")
    found = ranks.with_previous(orders, "account_id", "occurred_at", "id", "p")
    sizes = found.groupBy(F.spark_partition_id().alias("t"), "account_id").agg(F.count(F.lit(1)).alias("count"), F.max("p"))
    assert max(r["count"] for r in sizes.collect() if r["account_id"] == 1) < 0.5 * orders.where("account_id = 1").count()
    got = rows(op.order_intervals(star))
    assert got == rows(op.order_intervals(Star.from_testdata(no_help, hot)))


def test_bitmaps_count_distinct_ids_at_every_grain(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), (F.col("id") % 7 % 4).alias("b"),
                                  F.when(F.col("id") % 13 > 0, F.col("id") * F.col("id") % 70001 - 5).alias("k"))
    made = bitmaps.id_bitmaps(df, ["a", "b"], "k")
    got = bitmaps.distinct_counts(made, [["a", "b"], ["a"], ["b"], []], ["a", "b"], "n")
    a, b = F.col("a"), F.col("b")
    want = df.groupingSets([[a, b], [a], [b], []], a, b).agg(F.grouping_id().alias("level"), F.count_distinct("k").alias("n"))
    assert rows(got) == rows(want)
    # bitmaps of parts merge to those of the whole
    parts = [bitmaps.id_bitmaps(df.where(c), ["a", "b"], "k") for c in ("k % 2 = 0", "k % 2 <> 0 and k < 30000", "k > 20000")]
    union = parts[0].unionAll(parts[1]).unionAll(parts[2])
    assert rows(bitmaps.distinct_counts(union, [["a"], []], ["a", "b"], "n")) == rows(want.where("level in (1, 3)"))


def test_high_growth_shuffles_no_order_ids(spark, hot):
    star = Star.from_testdata(spark, hot)
    plan = executed_plan(op.high_growth(star, per_year=1))
    exchanged = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert exchanged and not any("o_orderkey" in e or re.search(r"\bid#", e) for e in exchanged)
    assert "count(distinct" not in plan
    # where ids may repeat they are compared
    twice = star.with_orders(lambda o: o.unionAll(o))
    from dataclasses import replace
    assert rows(op.high_growth(replace(twice, unique_orders=False, _memo={}), per_year=1)) == rows(op.high_growth(star, per_year=1))


def test_a_scope_too_big_to_broadcast_filters_the_facts(no_help, hot):
    from meridian.plans import scope
    star = Star.from_testdata(no_help, hot, broadcast_rows=0)
    s = scope.scope_region(star, "ASIA")
    ids = {r["id"] for r in s.accounts.collect()}
    facts = star.orders.select("account_id", "id")
    for bits in (1 << 20, 64):  # ample, and so few that most pass
        kept = {r["id"] for r in scope.might_be_scoped(s, facts, bits).collect()}
        inside = {r["id"] for r in facts.collect() if r["account_id"] in ids}
        assert inside <= kept and (bits == 64 or kept == inside)
    for name in ("lifetime_value", "sales_by_region", "sales_by_year", "rep_channel_counts", "churn", "cohort_retention"):
        df = getattr(op, name)(star, "ASIA")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "getbit(" in plan, (name, plan)
        tree = df._jdf.queryExecution().optimizedPlan().toString()
        # directly on the scan, so before any shuffle
        assert re.search(r"\n([ :]*)\+- Filter [^\n]*getbit.*?\n\1   \+- Relation \[(o_orderkey|event_id)", tree, re.S), (name, tree)
        assert rows(df) == rows(getattr(op, name)(Star.from_testdata(no_help, hot), "ASIA")), name


def test_matrix_stands_any_channel_name(spark, hot):
    star = Star.from_testdata(spark, hot)
    odd = ["null", None, "X", "x", "a.b", "sales_rep_name", "`q`", "view"]
    name = F.element_at(F.array(*[F.lit(c) for c in odd]), (F.col("id") % len(odd) + 1).cast("int"))
    some = star.narrowed(web_events=star.web_events.withColumn("channel", name))
    wide = op.rep_channel_matrix(some)
    assert wide.columns == ["sales_rep_name", "X", "`q`", "a.b", "null", "sales_rep_name_2", "view", "x_2", "null_2"]
    long = {}
    for r in op.rep_channel_counts(some).collect():
        long[r["sales_rep_name"], r["channel"]] = r["number_of_occurrences"]
    place = dict(zip(["X", "`q`", "a.b", "null", "sales_rep_name", "view", "x", None], range(1, 9)))
    for r in wide.collect():
        for c, at in place.items():
            assert r[at] == long.get((r[0], c), 0)
    none = op.rep_channel_matrix(star.narrowed(web_events=star.web_events.limit(0)))
    assert none.columns == ["sales_rep_name"] and none.collect() == []
