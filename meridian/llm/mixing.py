"""Mixing sources to target weights (operator 10).

Hierarchical budgeting over a tree of columns (domain, language, source): a token budget is split among the
children of the root by weight, each child's part among its own children, down to the leaves. A
node can give at most its tokens times ``max_epochs``; what a child can't give goes to its
siblings first, and only what all of them can't give to the siblings of their parent. Each leaf's budget is
filled with whole epochs and, of one more, the prefix of a seeded order that reaches the budget.

All of it is joins and windows over the table of tree nodes; of the documents only
(id, leaf, tokens) is stored and shuffled, never texts. A leaf's prefix is found over sums of buckets of
its order, and documents are ranked only inside the one bucket where the budget ends, so a
leaf with most of the rows is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.llm.common import stored

MISSING = ""          # name of a null level
BUCKET_DIGITS = 3     # hex digits of the order's hash that name a bucket


def tokens_of(text: Column | str) -> Column:
    """White-space separated words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights_table(spark: SparkSession, levels: list[str], weights: dict[tuple[str, ...], int]) -> DataFrame:
    """Weights by path from the root, e.g. ``{("web",): 3, ("web", "en"): 2}``, as a small table."""
    rows = [(len(path), "\x1f".join(path), int(w)) for path, w in weights.items()]
    return spark.createDataFrame(rows, "depth int, path string, weight long")


def _path(levels: list[str], depth: int) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in levels[:depth]))


def budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """(leaf path, available, budget) from (levels..., tokens): integer budgets by water-filling.
    Leaves under a node of weight 0 have no budget and no row.

    A path without a weight has weight 1, so children are equal unless told otherwise. With children in the
    order of capacity over weight, a child is full if the parent's budget reaches it: those
    before it full, those after it at its own ratio. Shares are rounded down.
    """
    at = {d: leaves.groupBy(_path(levels, d).alias("path")).agg(F.sum("tokens").alias("tokens"))
          for d in range(1, len(levels) + 1)}
    given = leaves.agg(F.least(F.lit(int(budget)), F.coalesce(F.sum("tokens"), F.lit(0)) * max_epochs).alias("budget"))
    given = given.select(F.lit("").alias("parent"), F.col("budget").cast("long").alias("budget"))
    for d in range(1, len(levels) + 1):
        w = F.broadcast(weights.where(F.col("depth") == d).select("path", "weight"))  # a parameter
        parent = F.substring_index("path", "\x1f", d - 1) if d > 1 else F.lit("")
        child = at[d].join(w, "path", "left").select(
            "path", parent.alias("parent"), "tokens", (F.col("tokens") * max_epochs).alias("capacity"),
            F.coalesce("weight", F.lit(1)).alias("weight"))
        child = child.join(given.select("parent", "budget"), "parent").where("weight > 0")
        order = Window.partitionBy("parent").orderBy(F.col("capacity").cast("double") / F.col("weight"), "path")
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        child = child.withColumn("left", F.col("budget") - before).withColumn("rest", rest)
        full = F.col("left").cast("decimal(38,0)") * F.col("weight") >= F.col("capacity").cast("decimal(38,0)") * F.col("rest")
        child = child.withColumn("full", full)
        open_ = Window.partitionBy("parent")
        used = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(open_)
        share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(open_)
        part = F.expr("if(share > 0, (cast(spare as decimal(38,0)) * weight) div share, 0)")
        child = child.withColumn("spare", F.col("budget") - used).withColumn("share", share)
        given = child.select(F.col("path").alias("parent"), "tokens", F.when(F.col("full"), F.col("capacity")).otherwise(
            part).cast("long").alias("budget"))
    return given.select(F.col("parent").alias("leaf"), F.col("tokens").alias("available"), "budget")


def mix(docs: DataFrame, levels: list[str], weights: DataFrame, budget_share: float = 1.0, max_epochs: int = 2,
        id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """(id, leaf, tokens, copies) of every row: how often it is taken, 0 for not at all.

    The budget is ``budget_share`` of all tokens. Null levels are children named ``MISSING``, null ids
    and texts are allowed; documents without words are taken if the prefix passes them. Rows
    of one id and text tie in the order and are told apart by nothing: they are taken or left
    together. A leaf without a budget, as under a node of weight 0, takes nothing; an empty input gives no rows.
    """
    # the texts are read once; the levels are renamed, so that they clash with no name in here
    at = [f"level{i}" for i in range(len(levels))]
    rows = docs.select(F.col(id_col).alias("id"), _path(levels, len(levels)).alias("leaf"), tokens_of(text_col).alias("tokens"),
                       *[F.col(c).cast("string").alias(a) for c, a in zip(levels, at)])
    rows = stored(rows, "mix-rows")
    leaves = stored(rows.groupBy(*at).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, at, weights, int(total * budget_share), max_epochs)
    plan = stored(plan.select("leaf", F.expr("if(available > 0, budget div available, 0)").alias("epochs"),
                              F.expr("if(available > 0, budget % available, 0)").alias("prefix")), "mix-plan")
    # the order of a leaf's documents in its last, partial epoch
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.select("id", "leaf", "tokens").join(plan, "leaf", "left").fillna(0, ["epochs", "prefix"]).withColumn("key", key)
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("n"), F.first("prefix").alias("prefix"))
    upto = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # a bucket lies before the budget's end (2), holds it (1), or lies behind it (0)
    sums = sums.select("leaf", "bucket", "before", F.expr(
        "case when before >= prefix then 0 when before + n < prefix then 2 else 1 end").alias("side"))
    placed = rows.join(sums, ["leaf", "bucket"])
    edge = placed.where("side = 1")
    inside = Window.partitionBy("leaf", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("own", F.sum("tokens").over(Window.partitionBy("leaf", "bucket", "key")))
    edge = edge.withColumn("before", F.col("before") + F.sum("tokens").over(inside) - F.col("own"))
    sure = placed.where("side <> 1").select("id", "leaf", "tokens", (F.col("epochs") + (F.col("side") == 2).cast("int")).alias("copies"))
    cut = edge.select("id", "leaf", "tokens", (F.col("epochs") + (F.col("before") < F.col("prefix")).cast("int")).alias("copies"))
    return sure.unionByName(cut).select(F.col("id").alias(id_col), "leaf", "tokens", F.col("copies").cast("long").alias("copies"))
