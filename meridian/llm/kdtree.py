"""Exact top-k by inner product with a KD-tree in each shard (operator 3).

Vectors become integers, floor(1024 * x). Shards are dealt by a hash of the row; in each a KD-tree is built by
median splits of the widest side, every node with the tight box of its rows. A query visits a tree
best first: a box's bound is the largest inner product that any point in it could have, and a
node is opened only if its bound reaches the query's k-th best score. Round one asks each query's first shard
alone; its k-th score goes with the query to the other shards in round two, where it prunes from the start.

The queries are a stated set; they meet a shard in blocks, so no task holds all of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import stored

SCALE, LEAF = 1024, 256
SHARD_ROWS, BLOCK_QUERIES = 16_384, 2_048
_EXACT = 2.0**53


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component x as double; null for a null vector and for one that holds a null
    or non-finite component or one beyond the long range."""
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(2.0**52 / SCALE)))
    return F.when(vector.isNotNull() & fits, wide)


class Tree:
    """A KD-tree over the rows of ``points`` (int64, n x d)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, stop, left, right (-1: a leaf)
        self.low, self.high = [], []
        self._split(points, 0, len(points), leaf)
        self.points = points[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        #: Inner products are exact in doubles while their terms' sum can't leave the 53 bits.
        self.largest = float(np.abs(self.points).max(initial=0)) * max(1, points.shape[1])
        self.floats = self.points.astype(float)

    def _split(self, points: np.ndarray, start: int, stop: int, leaf: int) -> int:
        rows = points[self.order[start:stop]]
        low, high = rows.min(axis=0), rows.max(axis=0)
        me = len(self.nodes)
        self.nodes.append((start, stop, -1, -1))
        self.low.append(low)
        self.high.append(high)
        if stop - start > leaf and (high > low).any():
            side = int((high - low).argmax())
            half = (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(rows[:, side], half)]
            left = self._split(points, start, start + half, leaf)
            right = self._split(points, start + half, stop, leaf)
            self.nodes[me] = (start, stop, left, right)
        return me

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest inner product each node's box allows, rounded up."""
        q = query.astype(float)
        sums = np.maximum(q, 0) @ self.high.T.astype(float) + np.minimum(q, 0) @ self.low.T.astype(float)
        return sums + np.abs(sums) * 1e-12

    def search(self, query: np.ndarray, keys: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, key), ties to smaller keys, but for rows of key ``own``; of those
        below ``least``, a known k-th score, none need be found."""
        bounds = self.bounds(query)
        exact = self.largest * float(np.abs(query).max(initial=0)) < _EXACT
        best: list[tuple[int, int]] = []  # a heap of (score, -key): its first is the worst
        floor = -np.inf if least is None else least
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            start, stop, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = (self.floats[start:stop] @ query.astype(float)).astype(np.int64) if exact else self.points[start:stop] @ query
            mine = keys[self.order[start:stop]]
            for i in np.flatnonzero((scores >= floor) & (mine != own)):
                item = (int(scores[i]), -int(mine[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -key) for s, key in best]


def _hits(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of each query's best in the shards it asks: ``asked`` has (dim, shard,
    query_id, q, least)."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            keys = left.column("id").to_numpy()
            points = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            tree = Tree(points.astype(np.int64))
            for batch in right.to_batches(BLOCK_QUERIES):
                for row in batch.to_pylist():
                    found = tree.search(np.array(row["q"], np.int64), keys, row["query_id"], k, row["least"])
                    out += [(row["query_id"], key, score) for score, key in found]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    asked = asked.select(F.col("dim").alias("asked_dim"), F.col("shard").alias("asked_shard"), "query_id", "q", "least")
    return shards.groupBy("dim", "shard").cogroup(asked.groupBy("asked_dim", "asked_shard")).applyInArrow(
        search, "query_id long, vec_id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row that ``is_query`` marks.

    Rows with a null id or a vector that ``integers`` refuses take no part, nor do empty vectors; vectors of
    another length are not compared. Rows that repeat a query's id count as its own; a
    repeated id is returned once for each of its rows that is among the best. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v"), is_query.alias("asks"))
    rows = stored(rows.where("id is not null and size(v) > 0").withColumn("dim", F.size("v")), "vectors")
    n = max(1, -(-rows.count() // shard_rows))
    place = F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    shards = rows.select("dim", place.alias("shard"), "id", "v")
    queries = rows.where("asks").select("dim", F.col("id").alias("query_id"), F.col("v").alias("q"), place_of_query(n).alias("home"))
    queries = queries.dropDuplicates(["query_id", "q"])
    first = queries.select("dim", F.col("home").alias("shard"), "query_id", "q", F.lit(None).cast("long").alias("least"))
    near = stored(_best(_hits(shards, first, k), k), "hits")
    if n > 1:
        least = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where("shard <> home")
        rest = rest.join(least, "query_id", "left").select("dim", "shard", "query_id", "q", "least")
        near = _best(near.drop("rank").unionByName(_hits(shards, rest, k)), k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def place_of_query(n: int) -> Column:
    """The shard that a query asks first."""
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
