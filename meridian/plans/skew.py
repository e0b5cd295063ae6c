"""A join that splits hot keys.

A shuffle join sends all rows of a key to one task. Where one key may hold a third of all rows, a bounded
frequency sketch of the large side finds the keys that are that frequent, their rows are dealt over many
tasks by a salt, and the other side's rows of just these keys are repeated once for each salt. All else is
joined as usual. Nothing here depends on adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that the frequency sketch tracks in each task, however many there are.
TRACKED = 4096


def hot_keys(rows: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys with about ``share`` of all rows or more: at most ``1 / share``, whatever the input.

    One job that reads the key only; one row reaches the driver. The sketch's counts are estimates, which
    is enough: a key wrongly listed or left out changes where rows are joined, never the result.
    The list is taken once, so that both sides of a join go by the same. Null is no key.
    """
    most = max(1, int(1 / share))
    top = F.expr(f"approx_top_k({key}, {most}, {max(TRACKED, most)})")
    found, n = rows.select(key).agg(top, F.count(F.lit(1))).first()
    return sorted(x["item"] for x in found or [] if x["item"] is not None and x["count"] >= n * share)


def split_join(left: DataFrame, right: DataFrame, on: str, spread: Sequence[str], how: str = "inner",
               share: float = 0.01, salts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` by the column ``on`` (``how``: inner, left, left_semi or left_anti).

    Rows of ``left``'s hot keys are dealt over ``salts`` tasks (by default the session's shuffle
    partitions) by a hash of the columns ``spread``, which should tell rows apart. Null keys, which join
    nothing, are dealt over the tasks, too. Columns named ``_salt`` are not allowed.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no split of a {how} join: rows of the right side would be kept once a salt")
    salts = salts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col(on).isin(hot_keys(left, on, share))
    dealt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    marked = left.withColumn("_salt", F.when(hot | F.col(on).isNull(), dealt).otherwise(F.lit(0)))
    every = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(right.withColumn("_salt", F.explode(every)), [on, "_salt"], how).drop("_salt")
