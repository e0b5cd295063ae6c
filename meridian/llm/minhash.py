"""Near-duplicate documents by MinHash (operator 1).

One-permutation hashing with optimal densification: a sketch is ``ROWS`` permutations of ``BANDS``
bins; a shingle falls in one bin of each permutation, a bin keeps its least value, and an empty
bin takes that of the first non-empty bin in a fixed random sequence of its own. Band j is bin j of
every permutation, so its rows are independent. A pair of similarity 0.75 shares a band
with probability 1 - (1 - 0.75**5)**44, about 1 - 7e-6.

Documents with equal shingle sets are one class. In each band bucket every class is joined by a star
edge to the bucket's centre, so candidates are at most one a class and band; links are confirmed on
the full sets. Buckets that still hold several components get further stars about other centres; what
these leave apart is compared within the bucket (see ``_cross_links``), so that no link is lost to
the choice of a centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import slices, stored
from meridian.llm.components import components

WORDS, PERCENT = 5, 75
ROWS, BANDS = 5, 44
TURNS = 2     # further stars, about other centres, for buckets that still hold several components
BLOCK = 1024  # classes of a bucket that are compared in one task
#: Below this share of equal sketch cells a pair can't be expected to reach PERCENT; see _cross_links.
LEAST_SHARE, LEAST_SHINGLES = 0.6, 48
_CACHE_WORDS = 300_000

_rng = np.random.RandomState(20260101)
_MULTIPLIERS = _rng.randint(1, 2**63, size=WORDS, dtype=np.uint64) | np.uint64(1)
_SEEDS = _rng.randint(1, 2**63, size=(ROWS, 1), dtype=np.uint64)
_BAND_MULTIPLIERS = _rng.randint(1, 2**63, size=(ROWS, 1), dtype=np.uint64) | np.uint64(1)
#: For each permutation and bin the bins it asks in turn when it is empty; ends with every bin.
_DONORS = np.concatenate([_rng.randint(0, BANDS, size=(ROWS, BANDS, 2 * BANDS)),
                          np.argsort(_rng.rand(ROWS, BANDS, BANDS), axis=2)], axis=2)
_EMPTY = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; emptied when full, which bounds memory only."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams of ``text``: A-Z lower-cased, words
    parted by ASCII white space. Fewer words give one hash of the whole sequence, none gives none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return _mix((w * _MULTIPLIERS[:n]).sum(keepdims=True) + np.uint64(n))
    h = w[:n - WORDS + 1] * _MULTIPLIERS[0]
    for j in range(1, WORDS):
        h = h + w[j:n - WORDS + 1 + j] * _MULTIPLIERS[j]
    return np.unique(_mix(h))


def sketch(found: np.ndarray) -> np.ndarray:
    """The ROWS x BANDS densified least values of a non-empty set of hashes."""
    x = _mix(found ^ _SEEDS)
    cell = ((x >> np.uint64(32)) * np.uint64(BANDS) >> np.uint64(32)).astype(np.int64) + np.arange(ROWS)[:, None] * BANDS
    out = np.full(ROWS * BANDS, _EMPTY)
    np.minimum.at(out, cell.ravel(), (x & np.uint64(0xFFFFFFFF)).ravel())
    out = out.reshape(ROWS, BANDS)
    full = out != _EMPTY
    if not full.all():
        for r, b in zip(*np.nonzero(~full)):
            asked = _DONORS[r, b]
            out[r, b] = out[r, asked[full[r, asked].argmax()]]
    return out


def band_keys(cells: np.ndarray) -> np.ndarray:
    return _mix((cells * _BAND_MULTIPLIERS).sum(axis=0) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _class_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        n, cls, bands, cells = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text, hashes)
            n.append(len(found))
            cls.append(_class_of(found))
            if len(found):
                s = sketch(found)
                bands.append(band_keys(s))
                cells.append((s & np.uint64(255)).astype(np.uint8).tobytes())
            else:
                bands.append([])
                cells.append(b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
             pa.array(cells, pa.binary())], names=["id", "n", "cls", "bands", "cells"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        sets = [shingles(text, hashes).view(np.int64) for text in batch.column(1).to_pylist()]
        cls = [_class_of(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                         names=["want", "cls", "grams"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (u, v) those whose full sets reach PERCENT."""
    mine = sets.select(F.col("cls").alias("v"), F.col("grams").alias("gv"))
    other = sets.select(F.col("cls").alias("u"), F.col("grams").alias("gu"))
    both = F.size(F.array_intersect("gu", "gv"))
    return (pairs.join(mine, "v").join(other, "u")
            .where(100 * both >= PERCENT * (F.size("gu") + F.size("gv") - both)).select("u", "v"))


def _sized(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component as ``label``."""
    label = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    label = label.select("key", "cls", "n", F.coalesce("root", "cls").alias("label"))
    keys = label.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return label.join(keys.where("low <> high and size > 2").select("key", "size"), "key")


def _star_again(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v) of a bucket's members with another centre, drawn by ``turn``, of another component."""
    drawn = F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n", "label")
    centers = mixed.groupBy("key").agg(F.min(drawn).alias("c"))
    centers = centers.select("key", F.col("c.cls").alias("u"), F.col("c.n").alias("center_n"), F.col("c.label").alias("center_label"))
    rows = mixed.join(centers, "key").where((F.col("label") != F.col("center_label")) & _sized("n", "center_n"))
    return rows.select("u", F.col("cls").alias("v")).distinct()


def _cross_links(mixed: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join components in buckets that still hold several: a spanning set of them.

    Members meet in tasks of at most two blocks of BLOCK classes, with their full sets. A pair is
    looked at in the first bucket it shares; sizes must allow PERCENT, and sketches of sets of
    LEAST_SHINGLES and more must have LEAST_SHARE of their cells equal (a pair of similarity 0.75
    falls short by chance only, five deviations off). Pairs never leave a task; links that join do.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = mixed.select("key", "cls", "n", "label", blocks.alias("blocks"))
    rows = rows.join(classes.select("cls", "cells", "bands"), "cls").join(sets, "cls")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                       "block", "cls", "n", "label", "cells", "bands", "grams")

    def compare(table: pa.Table) -> pa.Table:
        key, p, q = (table.column(k)[0].as_py() for k in ("key", "p", "q"))
        block, cls, n, label = (table.column(k).to_numpy() for k in ("block", "cls", "n", "label"))
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(len(cls), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        grams = table.column("grams").combine_chunks()
        flat, ends = grams.flatten().to_numpy(), np.cumsum([0, *grams.value_lengths().to_numpy()])
        group = {x: x for x in set(label.tolist())}

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        u, v = [], []
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        for i in left:
            mine = np.array([root(x) for x in label[right].tolist()])
            near = (mine != root(label[i])) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))
            j = right[near & (cls[right] < cls[i])] if p == q else right[near]
            if not len(j):
                continue
            share = (cells[j] == cells[i]).mean(axis=1)
            order = np.argsort(-share, kind="stable")
            j = j[order][(share[order] >= LEAST_SHARE) | (n[j[order]] < LEAST_SHINGLES)]
            common = bands[j] == bands[i]
            j = j[np.where(common, bands[j], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == key]
            if not len(j):
                continue
            own = flat[ends[i]:ends[i + 1]]
            both = np.array([np.isin(flat[ends[x]:ends[x + 1]], own, assume_unique=True, kind="sort").sum() for x in j])
            for x in j[100 * both >= PERCENT * (n[i] + n[j] - both)]:
                if root(label[x]) != root(label[i]):
                    group[root(label[x])] = root(label[i])
                    u.append(int(cls[i]))
                    v.append(int(cls[x]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("key", "p", "q").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, n_shingles, component_id, kept).

    ``component_id`` is the smallest id reachable by links (100 * intersection >= 75 * union of the
    shingle sets), the document's own included; ``kept`` marks the document with that id. Null and
    empty texts have no shingles and no links. Rows without an id link with nothing, have a null
    component and are kept. Rows that repeat an id are separate documents. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stored(texts.mapInArrow(_sketches, "id long, n long, cls long, bands array<long>, cells binary"), "sketches")
    filled = sketched.where("n > 0 and id is not null")
    ids = filled.groupBy("cls").agg(F.min("id").alias("id"))
    classes = filled.groupBy("cls", "n").agg(F.first("bands").alias("bands"), F.first("cells").alias("cells"))

    banded = classes.select("cls", "n", F.explode("bands").alias("key"))
    centers = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("cls", "n")).alias("c"))
    centers = centers.where("size > 1").select("key", F.col("c.cls").alias("center"), F.col("c.n").alias("center_n"))
    members = stored(banded.join(centers, "key"), "buckets")  # rows of buckets with two classes or more

    involved = members.select("cls").distinct().join(ids, "cls").select(F.col("id").alias("id"), F.col("cls").alias("want"))
    grams = texts.join(involved, "id").select("want", "text").mapInArrow(_sets, "want long, cls long, grams array<long>")
    sets = stored(grams.where("want = cls").dropDuplicates(["cls"]).select("cls", "grams"), "sets")

    star = members.where("cls <> center").where(_sized("n", "center_n"))
    links = stored(_confirmed(star.select(F.col("center").alias("u"), F.col("cls").alias("v")).distinct(), sets), "links")
    roots = stored(components(links), "roots")
    def joined(new: DataFrame) -> DataFrame:  # a component so far is a star about its root
        return stored(components(roots.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(new)), "roots")

    for turn in range(TURNS):
        again = stored(_confirmed(_star_again(_mixed(members, roots), turn), sets), "links")
        if not again.isEmpty():
            roots = joined(again)
    more = stored(_cross_links(_mixed(members, roots), classes, sets), "links")
    if not more.isEmpty():
        roots = joined(more)

    named = ids.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "id", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    found = named.join(least, "root").select("cls", "component_id")
    out = sketched.select("id", "n", "cls").join(found, "cls", "left")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
