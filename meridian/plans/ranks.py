"""Ranks over all rows and neighbours of a row, without sending all rows or a hot key's rows to one task.

Both cut an order into ranges by literal bounds, taken once from approximate percentiles: the bounds decide
which task does the work, never the result, and a recomputed task cuts the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.plans.skew import hot_keys, split_join


def _bounds(rows: DataFrame, value: str, ranges: int) -> list:
    """At most ``ranges - 1`` values that cut ``rows`` into ranges of about the same number of rows."""
    at = [i / ranges for i in range(1, ranges)]
    if not at:
        return []
    found = rows.agg(F.percentile_approx(value, at, 10 * ranges)).first()[0]
    return sorted(set(found or []))


def _range_of(value: Column, bounds: list, kind: str) -> Column:
    """The number of bounds below ``value``, by halving: as many comparisons as the bounds have binary digits."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value > F.lit(bounds[mid]).cast(kind), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds))


def dense_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(value, ``name``): the dense rank, largest first, of each distinct value of the column; NULL comes last.

    The distinct values are cut into ranges; each range numbers its own, and the number of values in the
    ranges above it is added, a prefix sum over one row a range. So a task holds one range of the distinct
    values, and what is broadcast one row a range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select(value).distinct()
    kind = rows.schema[value].dataType.simpleString()
    found = values.withColumn("_r", _range_of(F.col(value), _bounds(values, value, ranges), kind))
    found = found.withColumn("_r", F.when(F.col(value).isNull(), -1).otherwise(F.col("_r")))  # below all ranges
    above = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).select(
        "_r", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_r").orderBy(F.col(value).desc_nulls_last()))
    ranked = found.withColumn("_own", own).join(F.broadcast(offsets), "_r")
    return ranked.select(value, (F.col("_own") + F.col("_above")).alias(name))


def with_dense_rank(rows: DataFrame, value: str, name: str, spread: list[str]) -> DataFrame:
    """``rows`` with ``name``, the dense rank of ``value`` among all rows, largest first and NULL last. Rows of a value that
    very many have are dealt over the tasks by the columns ``spread``."""
    ranks = dense_ranks(rows, value, name)
    known = split_join(rows, ranks.where(F.col(value).isNotNull()), value, spread, "left")
    last = ranks.where(F.col(value).isNull()).agg(F.max(name).alias(name)).scalar()  # one value, if any
    return known.withColumn(name, F.coalesce(name, last))


def with_previous(rows: DataFrame, key: str, order: str, tie: str, name: str, share: float = 0.01) -> DataFrame:
    """``rows`` with ``name``, the value of ``order`` in the row before it of the same ``key`` (by ``order``, then ``tie``).

    A key's rows are one window, unless a frequency sketch finds the key hot: then they are cut into ranges
    of ``order``, each a window of its own, and the first row of a range takes its value from the last row of the
    range before it, which is carried over the border in a table of one row a hot key and range.
    Rows without a key or an order have no place in the sequence and are left out.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    own = Window.partitionBy(key).orderBy(order, tie)
    hot = hot_keys(rows, key, share)
    if not hot:
        return rows.withColumn(name, F.lag(order).over(own))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[order].dataType.simpleString()
    number = F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else F.col(order).cast("double")
    bounds = _bounds(rows.where(F.col(key).isin(hot)).select(number.alias("_v")), "_v", ranges)
    cut = F.when(F.col(key).isin(hot), _range_of(number, bounds, "long" if kind.startswith("timestamp") else "double")).otherwise(F.lit(0))
    rows = rows.withColumn("_r", cut)
    inside = rows.withColumn(name, F.lag(order).over(Window.partitionBy(key, "_r").orderBy(order, tie)))
    last = rows.where(F.col(key).isin(hot)).groupBy(key, "_r").agg(F.max(order).alias("_last"))
    border = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_r"))).drop("_last")
    # at most 1 / share keys times the ranges
    out = inside.join(F.broadcast(border), [key, "_r"], "left")
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_r", "_carried")
