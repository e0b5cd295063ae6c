"""Exact distinct counts that merge: sets of ids as bitmaps.

An id's bucket and its bit in the bucket's bitmap stand for it. A group's set is one row a bucket, of 4 KB
for 32,768 ids; sets of finer groups are united by OR, so that the distinct count of any coarser group, of
several years or of all comes from the stored bitmaps without the facts. Ids are dealt by (group, bucket) before
a bitmap is made, so a task holds few bitmaps and no group, however large, is in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bitmaps(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(*by, bucket, bits): the set of non-NULL ``key`` values (whole numbers) of each group as bitmaps.

    Ids that are thousands apart make bitmaps of few bits: then 4 KB stand for few ids, so this is for ids
    that are numbered on, as those of accounts are."""
    found = rows.where(F.col(key).isNotNull())
    found = found.select(*by, F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"))
    found = found.distinct()  # a hot id collapses in its tasks, and a group's bucket holds 32,768 rows at most
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, *by, "bucket").groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def distinct_counts(bitmaps: DataFrame, sets: list[list[str]], keys: list[str], name: str) -> DataFrame:
    """(*keys, level, ``name``): the exact number of distinct ids for each of the grouping ``sets`` of ``keys``.

    ``level`` is the grouping id (a bit for each key that is summed up). Bitmaps of a bucket are united for
    each set, then their bits are counted."""
    def columns(names: list[str]) -> list[Column]:
        return [F.col(c) for c in names]

    united = bitmaps.groupingSets([columns([*s, "bucket"]) for s in sets], *columns([*keys, "bucket"])).agg(
        F.grouping_id().alias("level"), F.bitmap_or_agg("bits").alias("bits"))
    # the bucket is in every set, the last key and so the lowest bit, which is 0
    return united.groupBy(*keys, F.shiftright("level", 1).alias("level")).agg(F.sum(F.bitmap_count("bits")).alias(name))
