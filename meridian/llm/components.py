"""Connected components of an undirected graph by alternating large-star and small-star.

Each half round is a map-side combined minimum per node and one join, so a node with very many
neighbours is pre-aggregated and its join rows are split by adaptive execution. Every round
is cut with a table in the shared folder; O(log^2 n) rounds, two or three for star-like input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import stored


def _hook(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over ``edges`` (u, v): hook the larger (or smaller) neighbours to the minimum."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    kept = both.join(low, "u")
    if small:
        hooked = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    else:
        hooked = kept.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v; longs, any direction, repeats allowed) to (node, root): the smallest
    node of its component. Only nodes with an edge are returned; an empty input gives no rows."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    mark = None
    while True:
        now = stored(_hook(_hook(now, small=False), small=True), "edges")
        new = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
