"""Embedding near-duplicates by dual traversal of cover trees (operator 9).

Vectors are compared on the unit sphere, where cosine >= c is a distance of at most sqrt(2 - 2c). The top
level of the tree are far-apart centres of a bounded sample; each vector lies in the shard of its nearest
one, and visits the later shards whose covering radius its distance allows. Below, each block of a shard has
two nested levels of halving radii. Two blocks are traversed together: a pair of nodes is
pruned if its centres are farther apart than both covering radii and the threshold, taken whole if
even the farthest descendants link (a node with itself, too), and opened otherwise; pairs of vectors left
over are counted from strips of cosines, those within rounding of the threshold decided by the vectors as given.

Equal vectors are one class with a count. A shard beyond BLOCK vectors is cut into blocks that
meet pair by pair, so no task holds more than two blocks, however many vectors share a place.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import slices, stored
from meridian.llm.components import components

BLOCK, SAMPLE, MOST_SHARDS = 4096, 4096, 1024
LEVELS = (0.5, 0.25)  # radii of the nested levels inside a block
STRIP = 256           # rows whose cosines with a node are held at a time
_CLOSE = 65_536       # pairs whose cosines are decided exactly at a time
_SLACK = 1e-6         # beyond the rounding of distances; what it leaves open is decided exactly


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def far_apart(points: np.ndarray, k: int) -> np.ndarray:
    """At most k points, each the farthest from those before it."""
    picked, gap = [0], np.full(len(points), np.inf)
    while len(picked) < min(k, len(points)):
        gap = np.minimum(gap, distances(points, points[picked[-1:]])[:, 0])
        if gap.max() <= 1e-9:
            break
        picked.append(int(gap.argmax()))
    return points[picked]


def cover(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the index of a centre within ``radius``; centres are more than that apart."""
    gram = points.astype(np.float32) @ points.T.astype(np.float32)
    near = gram >= 1 - radius * radius / 2 - 1e-6
    home = np.arange(len(points))
    crowded = np.flatnonzero(near.sum(axis=1) > 1)
    open_ = np.zeros(len(points), bool)
    open_[crowded] = True
    for i in crowded:
        if open_[i]:
            mine = np.flatnonzero(near[i] & open_)
            home[mine] = i
            home[i] = i
            open_[mine] = False
            open_[i] = False
    return home


class _Nodes:
    """A level's nodes over rows with labels: rows grouped by node, centre and covering radius of each."""

    def __init__(self, labels: np.ndarray, points: np.ndarray, rows: np.ndarray):
        order = rows[np.argsort(labels[rows], kind="stable")]
        _, starts = np.unique(labels[order], return_index=True)
        self.members = np.split(order, starts[1:]) if len(order) else []
        self.centers = points[order[starts]] if len(order) else points[:0]
        self.radius = np.array([distances(points[m], points[m[:1]]).max() + 1e-7 if len(m) > 1 else 0.0 for m in self.members])


def traverse(a: dict, b: dict, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between two blocks (or inside one, if ``same``): the links' weight at each row of a
    and of b, and of the links those that span what they join, fewer than there are rows. A block has raw, unit, weight, coarse and fine."""
    t = math.sqrt(2 - 2 * cosine)
    na, nb = np.zeros(len(a["unit"]), np.int64), np.zeros(len(b["unit"]), np.int64)
    edges, shift = [], 0 if same else len(a["unit"])
    group = np.arange(len(a["unit"]) + (0 if same else len(b["unit"])))  # of rows of a, then of b: joined so far

    def star(i: int, js: np.ndarray) -> None:
        """Row i of a links with rows js of b: edges to one row of each group that is not yet i's."""
        found, first = np.unique(group[js + shift], return_index=True)
        other = found != group[i]
        if other.any():
            edges.extend((i, int(j)) for j in js[first[other]])
            group[np.isin(group, found[other])] = group[i]

    def whole(x: np.ndarray, y: np.ndarray) -> None:
        na[x] += b["weight"][y].sum()
        nb[y] += a["weight"][x].sum()
        star(int(x[0]), y)
        for i in x[group[x] != group[y[0] + shift]]:
            star(int(i), y[:1])

    def whole_itself(x: np.ndarray) -> None:
        na[x] += a["weight"][x].sum() - a["weight"][x]
        star(int(x[0]), x[1:])

    def single(x: np.ndarray, y: np.ndarray, itself: bool = False) -> None:
        """Pairs of rows x of a and y of b, a strip of rows at a time; ``itself``: x is y, each pair once."""
        for at in range(0, len(x), STRIP):
            rows, cols = x[at:at + STRIP], y[at:] if itself else y
            gram = a["unit"][rows] @ b["unit"][cols].T
            link = gram >= cosine + 1e-9
            i, j = np.nonzero((gram >= cosine - 1e-9) & ~link)  # within rounding of the threshold
            for k in range(0, len(i), _CLOSE):
                u, v = i[k:k + _CLOSE], j[k:k + _CLOSE]
                p, q = a["raw"][rows[u]], b["raw"][cols[v]]
                exact = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
                link[u, v] = exact >= cosine
            if itself:
                link = np.triu(link, 1)
            na[rows] += (link * b["weight"][cols]).sum(axis=1)
            nb[cols] += (a["weight"][rows] @ link)
            apart = link & (group[rows][:, None] != group[cols + shift][None, :])
            for k in np.flatnonzero(apart.any(axis=1)):
                star(int(rows[k]), cols[apart[k]])

    def pairs(x: _Nodes, y: _Nodes, itself: bool) -> Iterator[tuple[int, int, float]]:
        d = np.sqrt(np.maximum(0, 2 - 2 * (x.centers.astype(np.float32) @ y.centers.T.astype(np.float32))))
        near = d <= (x.radius[:, None] + y.radius[None, :] + t + 1e-3).astype(np.float32)
        if itself:
            near &= np.arange(d.shape[0])[:, None] <= np.arange(d.shape[1])[None, :]
        for i, j in zip(*np.nonzero(near)):
            yield int(i), int(j), float(distances(x.centers[i:i + 1], y.centers[j:j + 1])[0, 0])

    fine: dict[tuple[int, int], _Nodes] = {}

    def opened(side: int, block: dict, top: _Nodes, i: int) -> _Nodes:
        if (side, i) not in fine:
            fine[side, i] = _Nodes(block["fine"], block["unit"], top.members[i])
        return fine[side, i]

    top_a = _Nodes(a["coarse"], a["unit"], np.arange(len(a["unit"])))
    top_b = top_a if same else _Nodes(b["coarse"], b["unit"], np.arange(len(b["unit"])))
    for i, j, _ in pairs(top_a, top_b, same):
        x, y = opened(0, a, top_a, i), opened(0 if same else 1, b, top_b, j)
        itself = same and i == j
        for k, m, d in pairs(x, y, itself):
            p, q = x.members[k], y.members[m]
            if itself and k == m:
                if len(p) > 1 and 2 * x.radius[k] <= t - _SLACK:
                    whole_itself(p)
                elif len(p) > 1:
                    single(p, p, True)
            elif d + x.radius[k] + y.radius[m] <= t - _SLACK:
                whole(p, q)
            else:
                single(p, q)
    return na, nb, edges


def spanning(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of ``edges`` those that join what those before them leave apart."""
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for x, y in edges:
        p, q = root(x), root(y)
        if p != q:
            group[p] = q
            out.append((x, y))
    return out


def _table_block(t: pa.Table) -> dict:
    raw = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    return {"raw": raw, "unit": unit(raw), "cls": t.column("cls").to_numpy(), "weight": t.column("m").to_numpy(),
            "coarse": t.column("coarse").to_numpy(), "fine": t.column("fine").to_numpy()}


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row: (id, n_links, component_id, kept).

    ``n_links`` counts the other rows with cosine >= ``cosine``, in doubles; ``component_id`` is the smallest id
    reachable by links, the row's own included; ``kept`` marks the row with that id. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing; vectors of
    another length are not compared. Rows without an id count as partners, have a null component
    if they link with no row that has one, and are kept. Repeated ids are rows of their own.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: F.abs(x) > 1e-150)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.withColumn("fit", F.coalesce(fine, F.lit(False)))
    rows = stored(rows.select("id", F.when(F.col("fit"), F.xxhash64("v")).alias("cls"), F.when(F.col("fit"), F.col("v")).alias("v")), "vectors")
    known = rows.where("cls is not null")
    classes = stored(known.groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")), "classes")
    sizes = classes.groupBy(F.size("v").alias("dim")).count().collect()  # one row for each length of vector
    found = None
    for dim, n in sizes:
        part = _links(classes.where(F.size("v") == dim), n, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = stored(found, "links")
    roots = stored(components(found.where("v is not null").select("u", "v")), "roots")
    linked = found.where("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n"))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "id", "m", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").join(linked, "cls", "left").select(
        "cls", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "cls").join(named, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, n: int, cosine: float) -> DataFrame:
    """(u, v, n) of classes of one length: links that join (u, v), and sums of links (u, null, n)."""
    spark = classes.sparkSession
    t = math.sqrt(2 - 2 * cosine)
    shards = min(MOST_SHARDS, max(1, -(-n // BLOCK)))
    sample = classes.orderBy(F.xxhash64("cls")).limit(max(SAMPLE, shards)).select("v").collect() if shards > 1 else classes.select("v").limit(1).collect()
    centers = far_apart(unit(np.array([r["v"] for r in sample], float)), shards)
    tops = spark.sparkContext.broadcast(centers)  # at most MOST_SHARDS vectors

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            raw = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            d = distances(unit(raw), tops.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))],
                                             names=["cls", "m", "v", "shard", "far"])

    placed = classes.select("cls", "m", "v").mapInArrow(homes, "cls long, m long, v array<double>, shard int, far double")
    about = {r["shard"]: (r["far"], r["n"]) for r in placed.groupBy("shard").agg(
        F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    reach = spark.sparkContext.broadcast(np.array([about.get(s, (-9.0, 0))[0] for s in range(len(centers))]))
    blocks = {s: max(1, -(-about.get(s, (0, 0))[1] // BLOCK)) for s in range(len(centers))}
    count = spark.createDataFrame([(s, b) for s, b in blocks.items()], "shard int, blocks int")

    def levels(table: pa.Table) -> pa.Table:
        points = unit(table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
        coarse = cover(points, LEVELS[0])
        fine = np.arange(len(points))
        for center in np.unique(coarse):
            mine = np.flatnonzero(coarse == center) if (coarse == center).sum() > 1 else None
            if mine is not None:
                fine[mine] = mine[cover(points[mine], LEVELS[1])]
        cls = table.column("cls").to_numpy()
        return table.append_column("coarse", pa.array(cls[coarse])).append_column("fine", pa.array(cls[fine]))

    placed = placed.join(F.broadcast(count), "shard").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    kinds = "cls long, m long, v array<double>, shard int, block int, blocks int"
    tree = stored(placed.select(*[c.split()[0] for c in kinds.split(", ")]).groupBy("shard", "block").applyInArrow(
        levels, kinds + ", coarse long, fine long"), "tree")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            raw = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            near = distances(unit(raw), tops.value) <= reach.value + t + _SLACK
            near &= np.arange(near.shape[1])[None, :] > batch.column("shard").to_numpy()[:, None]
            i, s = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(i)) for c in ("cls", "m", "v", "shard", "block", "coarse", "fine")), pa.array(s, pa.int32())],
                names=["cls", "m", "v", "home", "part", "coarse", "fine", "shard"])

    cols = ["cls", "m", "v", "coarse", "fine"]
    # blocks of one shard: each row goes to every pair of blocks that its own is in
    inner = tree.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inner = inner.select(*cols, "shard", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                         F.lit(-1).alias("home"), (F.col("block") > F.col("other")).alias("right"))
    # visitors: the block they come from meets every block of the shard they visit
    guests = tree.mapInArrow(visits, "cls long, m long, v array<double>, home int, part int, coarse long, fine long, shard int")
    guests = guests.join(F.broadcast(count), "shard").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    guests = guests.select(*cols, "shard", "p", F.col("part").alias("q"), "home", F.lit(True).alias("right"))
    hosts = guests.select("shard", "p", "q", "home").distinct()
    hosts = tree.select(*cols, F.col("shard"), F.col("block").alias("p")).join(hosts, ["shard", "p"]).select(
        *cols, "shard", "p", "q", "home", F.lit(False).alias("right"))

    def meet(table: pa.Table) -> pa.Table:
        right = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
        same = table.column("home")[0].as_py() < 0 and table.column("p")[0].as_py() == table.column("q")[0].as_py()
        u, v, k = [], [], []
        if same or right.any() and not right.all():
            a = _table_block(table if same else table.filter(pa.array(~right)))
            b = a if same else _table_block(table.filter(pa.array(right)))
            na, nb, edges = traverse(a, b, same, cosine)
            total = [(a, na + nb)] if same else [(a, na), (b, nb)]
            for side, sums in total:
                at = np.flatnonzero(sums)
                u += side["cls"][at].tolist()
                v += [None] * len(at)
                k += sums[at].tolist()
            joins = spanning((int(a["cls"][i]), int(b["cls"][j])) for i, j in edges)
            u += [x for x, _ in joins]
            v += [y for _, y in joins]
            k += [0] * len(joins)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(k, pa.int64())})

    together = inner.unionByName(guests).unionByName(hosts)
    return together.groupBy("shard", "p", "q", "home").applyInArrow(meet, "u long, v long, n long")
