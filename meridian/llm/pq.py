"""Vector code compression: product quantisation in whole numbers.

Vectors are scaled to integers and cut into parts; each part has a codebook of entries, learned by rounds
of assigning every part to its nearest entry and moving the entry to the mean of its parts. The nearest
entry is found by slices and bitmasks: a codebook's coordinates are sorted in each dimension and carry
prefix masks of the entries before them. The distance to one entry is a radius that the nearest one
can't exceed, so in each dimension only the entries within it remain, a slice whose mask is the
difference of two prefix masks; the AND over the dimensions leaves the candidates, whose distances decide.

A round is one pass over the vectors. Tasks add up their own parts and emit one row a codebook
component, so what reaches the driver is as large as the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import stored
from meridian.plans.skew import split_join

#: Scaled components lie below this, so that squared distances are exact in 64 bits.
LARGEST = 1 << 26
#: Vectors that a task holds as numbers at a time.
ROWS = 8192


@dataclass(frozen=True)
class Codebooks:
    """``books[part][entry, position]``, whole numbers; entries of unequal parts have their own length."""

    books: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components, decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


class _Masks:
    """A codebook's sorted coordinates and prefix masks: ``nearest`` entries of many parts."""

    def __init__(self, book: np.ndarray):
        self.book, (self.n, self.dims) = book, book.shape
        words = -(-self.n // 64)
        bits = np.zeros((self.n, words), np.uint64)
        bits[np.arange(self.n), np.arange(self.n) // 64] = np.uint64(1) << (np.arange(self.n) % 64).astype(np.uint64)
        self.sorted, self.prefix = [], []
        for d in range(self.dims):
            order = np.argsort(book[:, d], kind="stable")
            self.sorted.append(book[order, d])
            self.prefix.append(np.concatenate([np.zeros((1, words), np.uint64), np.bitwise_or.accumulate(bits[order], axis=0)]))
        sums = book.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of ``x`` in every dimension."""
        mask = None
        for d in range(self.dims):
            low = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            inside = self.prefix[d][high] & ~self.prefix[d][low]  # the slice low..high
            mask = inside if mask is None else mask & inside
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry nearest to each row of ``x`` (ties: the lower index) and its squared distance."""
        if not self.dims:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        guess = self.by_sum[np.minimum(np.searchsorted(self.sums, x.sum(axis=1)), self.n - 1)]
        bound = ((x - self.book[guess]) ** 2).sum(axis=1)
        mask = self.candidates(x, np.sqrt(bound).astype(np.int64) + 1)  # one more than the root, whatever its rounding
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        for e in range(self.n):
            rows = np.flatnonzero(mask[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            if len(rows):
                far = ((x[rows] - self.book[e]) ** 2).sum(axis=1)
                less = far < best[rows]
                best[rows[less]], at[rows[less]] = far[less], e
        return at, best


def _cuts(length: int, parts: int) -> list[int]:
    return [length * p // parts for p in range(parts + 1)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some, some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, -1)


def scaled(df: DataFrame, vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null where the vector is null, empty, or has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")).cast("int"))

    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, whole))


def prepared(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 4096, keep: list[str] = ()) -> DataFrame:
    """(id, v, *keep) of the usable vectors, written as a table. Vectors of another length than that of the
    first one (smallest id) are not comparable and left out, as are null and empty ones and those with a null
    or non-finite component. Components have to stay below LARGEST after scaling."""
    kept = df.select(F.col(id_col).cast("long").alias("id"), scaled(df, vector, scale).alias("v"), *keep).where("v is not null")
    kept = stored(kept, "vectors")
    lengths = kept.groupBy(F.size("v").alias("n")).agg(F.min("id").alias("id")).orderBy(F.col("id").asc_nulls_last(), "n").limit(1).collect()
    return kept.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def fit(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of prepared vectors (id, v); None where there are none.

    They start as the parts of the ``entries`` smallest ids' vectors (all, if fewer; null ids last, equal ids
    by their components), and are moved ``rounds`` times; an entry's new components are the floored means
    of its parts' components, entries without parts stay. At most 256 entries: a code is a byte.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    start = np.array([r["v"] for r in first], np.int64)
    cuts = _cuts(start.shape[1], parts)
    books = [start[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]

    def sums(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            masks = [_Masks(b) for b in books]
            total, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for _, x in _matrices(batches):
                for p, m in enumerate(masks):
                    mine = x[:, cuts[p]:cuts[p + 1]]
                    at, _ = m.nearest(mine)
                    np.add.at(total[p], at, mine)
                    count[p] += np.bincount(at, minlength=m.n)
            for p, (t, n) in enumerate(zip(total, count)):  # a row a component, and one (at -1) for the number
                e, d = (g.ravel() for g in np.indices(t.shape)) if t.size else (np.zeros(0, int),) * 2
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(t.size + len(n), p), pa.int32()), pa.array(np.concatenate([e, np.arange(len(n))]), pa.int32()),
                    pa.array(np.concatenate([d, np.full(len(n), -1)]), pa.int32()), pa.array(np.concatenate([t.ravel(), n]), pa.int64())],
                    names=["part", "entry", "at", "total"])
        return run

    for _ in range(rounds):
        added = rows.select("v").mapInArrow(sums(books), "part int, entry int, at int, total long")
        added = added.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()  # a row a component
        found = {(r["part"], r["entry"], r["at"]): r["total"] for r in added}
        moved = [b.copy() for b in books]
        for (p, e, d), total in found.items():
            if d >= 0 and found[p, e, -1]:
                moved[p][e, d] = total // found[p, e, -1]  # floors, below zero as well
        books = moved
    return Codebooks(books)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``rows`` (id, v, ...) with ``code`` (two hex digits a part) and ``error`` (squared distances, added up) for v."""
    books = codebooks.books
    cuts = np.cumsum([0, *[b.shape[1] for b in books]])
    others = [c for c in rows.columns if c != "v"]
    ids = [rows.schema[c] for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [_Masks(b) for b in books]
        for some, x in _matrices(batches):
            found = [m.nearest(x[:, a:b]) for m, a, b in zip(masks, cuts, cuts[1:])]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), pa.array(text, pa.string()),
                                              pa.array(sum(far for _, far in found), pa.int64())], names=[*others, "code", "error"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*ids, StructField("code", StringType()), StructField("error", LongType())]))


def decode(codes: DataFrame, codebooks: Codebooks, scale: int = 4096, code_col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, in the original scale."""
    books = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in b.tolist()]) for b in codebooks.books])
    places = F.sequence(F.lit(0), F.lit(len(codebooks.books) - 1))
    entry = lambda p: F.conv(F.substr(F.col(code_col), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.transform(places, lambda p: F.get(F.get(books, p), entry(p)))))


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label_col: str = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(id, code, error, label_error) of each usable vector, and the codebooks.

    ``label_error`` is the error summed over the rows of the same label, nulls together. Labels may be
    many, and one may hold most rows: they are summed by partial aggregates, and the sums meet the rows in a
    join that splits hot labels. Rows that repeat an id are separate rows; other columns are ignored.
    """
    label = F.coalesce(F.concat(F.lit("v"), F.col(label_col).cast("string")), F.lit("n")).alias("of")
    rows = prepared(df, id_col, vector, scale, [label])
    books = fit(rows, parts, entries, rounds)
    if books is None:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error")), None
    coded = stored(encode(rows, books), "codes")
    sums = coded.groupBy("of").agg(F.sum("error").alias("label_error"))
    out = split_join(coded, sums, "of", ["id", "code"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books
