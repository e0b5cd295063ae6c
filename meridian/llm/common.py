"""Helpers shared by the training-data operators: shared scratch tables, Arrow slices, bounds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meridian.plans.scratch import new_path, shared_dir, stored  # noqa: F401


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release_memory() -> None:
    """Give the memory of objects that are gone back to the system: the driver runs stage after stage in one
    process, and allocators keep what the largest of them once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which gives back on its own
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on a task's batches, which at its end gives their memory back: the worker waits for other tasks, beside
    those that work then."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers of which each is dealt to a partition of its own among ``n``: keys for batches of equal size,
    which by their numbers alone would meet in some partitions and leave others empty."""
    key = F.col("id").cast("int")
    found = spark.range(60 * n).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("at")).agg(F.min(key).alias("key")).collect()
    keys = {r["at"]: r["key"] for r in found}  # n rows
    taken = iter(range(60 * n, 61 * n))
    return [keys[i] if i in keys else next(taken) for i in range(n)]


def appended(df: DataFrame, schema: str, inputs: list[str], fn: Callable[[], Callable[..., list]], together: bool = False) -> DataFrame:
    """``df`` with the columns of ``schema``, computed row by row from its columns ``inputs``.

    ``fn`` is called once a task and gives the function of one row's inputs; that one returns the new
    columns' values. With ``together`` it gets the inputs of some rows, as lists, and returns as many rows' values. ``df``'s own columns pass through as Arrow data, but for those that a new one
    replaces because it has their name.
    """
    at = [df.columns.index(c) for c in inputs]
    new = StructType.fromDDL(schema)
    taken = {name.lower() for name in new.names}
    own = [i for i, c in enumerate(df.columns) if c.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        row, kinds = fn(), to_arrow_schema(new)
        for batch in slices(batches):
            given = [batch.column(i).to_pylist() for i in at]
            made = row(*given) if together else [row(*v) for v in zip(*given)]
            cols = zip(*made) if made else [[] for _ in new]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in own), *(pa.array(list(c), f.type) for c, f in zip(cols, kinds))],
                names=[*(batch.schema.names[i] for i in own), *kinds.names])

    return df.mapInArrow(releasing(run), StructType([*(df.schema.fields[i] for i in own), *new.fields]))


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, most: int, seed: int) -> DataFrame:
    """(id, label) of at most ``most`` rows of each of the labels 0 and 1, those of the least seeded hash.

    A repeated id counts once, with its largest label; null ids and labels don't count. The bound is
    a parameter, so the result may be broadcast.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id"))
    one = one.agg(F.max(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64("id", F.lit(seed)))
    parts = [one.where(F.col("label") == y).orderBy("h", "id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("id", "label")


def uniform(*keys: Column | str, seed: int) -> Column:
    """A number in (0, 1) from a seeded hash of ``keys``: the same for the same row in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a finite double column, exactly; None where there are fewer rows than k.

    Counts by bins of a shrinking range, so that at most ``bins`` numbers reach the driver.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    left = k  # the value sought is the left-th largest in [low, high]
    while n > bins and high > low:
        wide = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / wide), F.lit(bins - 1)).alias("bin")
        inside = df.where(F.col(column).between(low, high))
        found = inside.groupBy(at).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(found.collect(), key=lambda r: -r["bin"]):
            if row["n"] >= left:
                break
            left -= row["n"]
        if (row["low"], row["high"]) == (low, high):
            break
        low, high, n = row["low"], row["high"], row["n"]
    if high == low:
        return high
    return df.where(F.col(column).between(low, high)).orderBy(F.desc(column)).select(column).limit(left).agg(F.min(column)).first()[0]
