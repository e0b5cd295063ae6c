"""Merkle dataset manifest: one digest of all rows, and for each row a proof that it belongs.

The rows of a group, in order of their keys, are the leaves of a tree in which every FANOUT consecutive
nodes become their common digest; the groups' roots, in order of the groups, are the leaves of one more
tree. A rank's digits to base FANOUT are its place on each level, so that a tree is rolled up by grouping
the digit columns away, one after the other, each time nesting the child structs. This is done in
blocks of FANOUT ** DIGITS nodes, which bounds a nested struct; blocks are nodes of the next round. On the way
down the blocks are nested again, now with the path above them in the same group, and are opened level
by level, which leaves one row a leaf with the siblings on its whole path: no join.

A hot group is many blocks. Ranks come from range partitions and the counts of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import shuffle_partitions, stored

FANOUT = 16
#: Levels that are nested in one struct.
DIGITS = 2
BLOCK = FANOUT ** DIGITS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of the parts' text, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column | str) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(c: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (0-based, by the columns ``order`` within ``group``, nulls first); written as a table.

    Rows are dealt by ranges of (group, order), a position completing the key, so that a hot group or
    repeated rows are spread; a range's ranks begin after those of the same group in earlier ranges.
    At most one group of a range began earlier, so the list of offsets has a row a range at most.
    """
    keys = [group, *order]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(shuffle_partitions(rows.sparkSession), *[F.col(k).asc_nulls_first() for k in keys], "_at")
    dealt = stored(dealt.drop("_at").withColumn("_part", F.spark_partition_id()), name)
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0")
    before = before.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_before")
    own = Window.partitionBy("_part", group).orderBy(*[F.col(k).asc_nulls_first() for k in order])
    found = dealt.withColumn("_own", F.row_number().over(own) - 1).join(
        F.broadcast(before), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return found.withColumn("rank", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_part", "_own", "_before", "_p", "_g")


def _placed(nodes: DataFrame, *carried: str) -> DataFrame:
    """``nodes`` (tree, rank, hash, carried) as (tree, block, the upper digits of the rank, kid)."""
    digits = [F.expr(f"rank div {FANOUT ** d} % {FANOUT}").cast("int").alias(f"d{d}") for d in reversed(range(1, DIGITS))]
    return nodes.select("tree", F.expr(f"rank div {BLOCK}").alias("block"), *digits,
                        F.struct(F.expr(f"cast(rank % {FANOUT} as int)").alias("digit"), "hash", *carried).alias("kid"))


def _hashed(kids: Column, first: Column) -> Column:
    """Whether children have a digest of their own: all but a tree's only node, which is its root already."""
    return ~(first & (F.size(kids) == 1))


def _blocks(placed: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(tree, block, hash, kids, up): the nested struct of each block and what ``up`` (tree, block, up) says is above it.
    Without ``up`` only digests are nested, a level at a time.

    Each block is dealt once, by (tree, block); grouping its digits away needs no further shuffle.
    """
    kind = "struct<path:array<struct<l:string,r:string>>,subroot:string,root:string>"
    rows = placed.withColumn("up", F.lit(None).cast(kind))
    if up is not None:
        rows = rows.unionByName(up, allowMissingColumns=True)
    rows = rows.repartition(shuffle_partitions(placed.sparkSession), "tree", "block")
    levels = [f"d{d}" for d in reversed(range(1, DIGITS))]
    for keys in [levels[:i] for i in reversed(range(len(levels) + 1))]:
        kids = F.sort_array(F.collect_list("kid"))
        rows = rows.groupBy("tree", "block", *keys).agg(kids.alias("kids"), F.first("up", ignorenulls=True).alias("up"))
        first = F.col("block") == 0
        for k in keys:
            first = first & (F.col(k) == 0)
        hashes = F.col("kids.hash")
        rows = rows.withColumn("hash", F.when(_hashed(F.col("kids"), first), F.sha2(F.array_join(hashes, ""), 256))
                               .otherwise(F.get(hashes, 0)))
        if keys:  # a level's row becomes a child; what is above has none
            kept = [F.col(keys[-1]).alias("digit"), "hash", *(["kids"] if up is not None else [])]
            rows = rows.withColumn("kid", F.when(F.size("kids") > 0, F.struct(*kept)))
            rows = rows.drop("kids", "hash", keys[-1])
    return rows


def _opened(blocks: DataFrame) -> DataFrame:
    """Nested blocks to a row for each node, (tree, rank, hash, carried, up), its path's siblings put before those above."""
    rows = blocks.select("tree", "kids", "up", F.col("block").alias("rank"))
    for level in reversed(range(DIGITS)):
        own = _hashed(F.col("kids"), F.col("rank") == 0)  # the prefix of digits so far is that of the first node
        rows = rows.select("tree", "up", "rank", own.alias("own"), F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("i", "kid"))
        sides = F.struct(F.array_join(F.slice("hashes", F.lit(1), F.col("i")), "").alias("l"),
                         F.array_join(F.slice("hashes", F.col("i") + 2, F.lit(FANOUT)), "").alias("r"))
        path = F.when(F.col("own"), F.concat(F.array(sides), F.col("up.path"))).otherwise(F.col("up.path"))
        up = F.struct(path.alias("path"), F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"))
        inner = [F.col("kid.kids").alias("kids")] if level else [F.col("kid.hash").alias("hash"), F.col("kid.carried").alias("carried")]
        rows = rows.select("tree", up.alias("up"), (F.col("rank") * FANOUT + F.col("kid.digit")).alias("rank"), *inner)
    return rows


def _rounds(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, leaves first, and (tree, hash): each tree's root."""
    rounds = [nodes]
    while True:
        tops = _blocks(_placed(rounds[-1])).select("tree", F.col("block").alias("rank"), "hash", F.lit(None).cast("string").alias("carried"))
        tops = stored(tops, name)
        if not tops.where("rank > 0").count():
            return rounds, tops.select("tree", "hash")
        rounds.append(tops)


def _down(rounds: list[DataFrame], up: DataFrame) -> DataFrame:
    """A row for each leaf, with its path; ``up`` (tree, up) is what is above each tree."""
    up = up.select("tree", F.lit(0).cast("long").alias("block"), "up")
    for nodes in reversed(rounds):
        leaves = _opened(_blocks(_placed(nodes, "carried"), up))
        up = leaves.select("tree", F.col("rank").alias("block"), "up")
    return leaves


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source",
             tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: (id, leaf, subroot, root, proof, proof_sha256, folded_root, verified).

    ``leaf`` is the digest of ``fields``; ``subroot`` the root of the row's group, ``root`` that of all
    groups. ``proof`` lists the siblings from the leaf up to the root, each level a struct of those to the
    left and to the right (their digests joined), ``proof_sha256`` is the digest of all of them, left to right.
    ``folded_root`` is computed from the proof and the row's leaf, in rows for which ``where`` holds from the
    leaf of the row with the columns ``tampered`` in their place; ``verified`` tells whether it equals ``root``.

    Null ids come first, null groups are a group, which comes first; equal ids are ordered by their leaf, so
    that repeated rows, each a leaf of its own, have the same set of proofs in any run. No rows give none.
    Other columns are ignored, whatever their names.
    """
    def leaf(changed: dict[str, Column]) -> Column:
        return digest(*[field(changed.get(c, F.col(c))) for c in fields])

    other = F.when(where if where is not None else F.lit(True), leaf(tampered)) if tampered else F.lit(None).cast("string")
    leaves = stored(docs.select(F.col(group_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"),
                                leaf({}).alias("hash"), other.alias("other")), "digests")
    # a null is told from any text by its first letter
    leaves = ranked(leaves, "tree", ["id", "hash"], "leaves").select(
        F.coalesce(F.concat(F.lit("v"), "tree"), F.lit("n")).alias("tree"), "rank", "hash", F.struct("id", "other").alias("carried"))
    rounds, subroots = _rounds(leaves, "nodes")
    forest = ranked(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("group"), "hash"), "tree", ["group"], "subroots")
    above, top = _rounds(forest.select("tree", "rank", "hash", F.col("group").alias("carried")), "forest")
    root = top.select("tree", F.struct(F.array().cast("array<struct<l:string,r:string>>").alias("path"),
                                       F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("up"))
    groups = _down(above, root).select(F.col("carried").alias("tree"), F.struct(
        F.col("up.path").alias("path"), F.col("hash").alias("subroot"), F.col("up.root").alias("root")).alias("up"))
    out = _down(rounds, stored(groups, "groups"))
    path = F.col("up.path")
    proof = F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), ""), 256)
    folded = F.aggregate(path, F.coalesce("carried.other", "hash"), lambda acc, p: F.sha2(F.concat(p["l"], acc, p["r"]), 256))
    out = out.select(F.col("carried.id").alias(id_col), F.col("hash").alias("leaf"), F.col("up.subroot").alias("subroot"),
                     F.col("up.root").alias("root"), path.alias("proof"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
