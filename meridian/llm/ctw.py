"""Language-model scores by context-tree weighting over bytes (operator 8).

A byte is coded as eight binary decisions; each decision node has a context tree over the bytes before, to
depth ``DEPTH``. A tree node's weighted probability of the training bits it saw mixes, half and half,
its own Krichevsky-Trofimov estimate and the product of its children's weighted probabilities; a new
bit's probability is the mixture of the estimates along its context, at the weights the training
text gave them. The sum over a text's bytes is its code length.

Documents are dealt into batches. A batch counts its distinct (DEPTH + 1)-grams and words, so
every gram travels once a batch and not once a position, to the shard of its context's last two bytes.
Shards add up the batches' counts and grow their subtrees; depths 0 and 1, at most 256 contexts, are put
together from the shards' sums and sent back to them. What a batch gets back is the log
probability of each of its grams and the count of each of its words, from which it scores its documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import shuffle_partitions, slices, spread_keys, stored

DEPTH = 5
END = 0xFF  # of a text; no UTF-8 text holds it
_CHUNK = 1 << 20
_SMALL = np.array([math.lgamma(i + 0.5) for i in range(64)])
_SMALL_1 = np.array([math.lgamma(i + 1.0) for i in range(64)])


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, parted by ASCII white space."""
    return (text or "").encode().lower().split()


def grams(words: list[bytes]) -> np.ndarray:
    """The context (last byte first) and byte at each position of the words, one space between two, and END,
    as integers: context bytes in falling order of weight, the byte itself lowest. Before the text are zeros."""
    raw = np.frombuffer(bytes(DEPTH) + b" ".join(words) + bytes([END]), np.uint8).astype(np.uint64)
    n = len(raw) - DEPTH
    out = raw[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        out |= raw[DEPTH - back:DEPTH - back + n] << np.uint64(8 * (DEPTH - back + 1))
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    pair = keys >> np.uint64(8 * (DEPTH - 1))
    return ((pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """log gamma(n + plus) of counts n; ``plus`` is 0.5 or 1."""
    x = n + plus
    big = np.maximum(x, 32.0)
    stirling = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    table = _SMALL if plus == 0.5 else _SMALL_1
    return np.where(n < 64, table[np.minimum(n, 63).astype(np.int64)], stirling)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - math.log(math.pi)


def _merged(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and each of ``sums`` added up by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], *(np.add.reduceat(s[order], starts) if len(starts) else s[:0] for s in sums)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte its eight decision nodes (1 .. 255) and bits, one row a decision."""
    k = np.arange(8, dtype=np.uint64)[:, None]
    return (np.uint64(1) << k) | (byte[None, :] >> (np.uint64(8) - k)), (byte[None, :] >> (np.uint64(7) - k)) & np.uint64(1)


class Level:
    """One depth's nodes of a shard: sorted keys (context * 256 + decision), zeros, ones, log KT, log weighted."""

    def __init__(self, contexts: np.ndarray, byte: np.ndarray, count: np.ndarray):
        node, bit = decisions(byte)
        keys = ((contexts[None, :] << np.uint64(8)) | node).ravel()
        tiled = np.broadcast_to(count.astype(float), node.shape)
        self.keys, self.zeros, self.ones = _merged(keys, np.where(bit == 0, tiled, 0.0).ravel(), np.where(bit == 1, tiled, 0.0).ravel())
        self.kt = self.weighted = log_kt(self.zeros, self.ones)

    def mix(self, keys: np.ndarray, weighted: np.ndarray) -> None:
        """Weigh in the children, given by their parents' keys."""
        below = np.bincount(np.searchsorted(self.keys, keys), weights=weighted, minlength=len(self.keys))
        self.weighted = np.logaddexp(self.kt, below) - math.log(2)

    def share(self) -> np.ndarray:
        """The weight of a node's own estimate against its children."""
        return np.exp(self.kt - math.log(2) - self.weighted)


def grow(keys: np.ndarray, counts: np.ndarray, least: int = 2) -> dict[int, Level]:
    """The levels least .. DEPTH of the trees of distinct grams."""
    byte, levels = keys & np.uint64(255), {}
    for d in range(DEPTH, least - 1, -1):
        context = keys >> np.uint64(8 * (DEPTH - d + 1))
        levels[d] = Level(context, byte, counts)
        if d < DEPTH:
            child = levels[d + 1]
            up = ((child.keys >> np.uint64(16)) << np.uint64(8)) | (child.keys & np.uint64(255))
            levels[d].mix(up, child.weighted)
    return levels


def log10_of(keys: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context, by all levels from the deepest up."""
    node, bit = decisions(keys & np.uint64(255))
    p = None
    for d in sorted(levels, reverse=True):
        level = levels[d]
        at = np.searchsorted(level.keys, ((keys >> np.uint64(8 * (DEPTH - d + 1)))[None, :] << np.uint64(8)) | node)
        own = (np.where(bit == 1, level.ones[at], level.zeros[at]) + 0.5) / (level.zeros[at] + level.ones[at] + 1)
        if p is None:
            p = own
        else:
            w = level.share()[at]
            p = w * own + (1 - w) * p
    return np.log10(p).sum(axis=0)


def _squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _spread(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _keys(x: bytes) -> np.ndarray:
    return np.cumsum(_spread(x, "<u8"), dtype=np.uint64)


_PACK = "batch int, shard int, kind string, keys binary, n binary"


def _pack_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["batch", "shard", "kind", "keys", "n"])


def _count_batch(to: list[int]):
    shards = len(to)

    def count(table: pa.Table) -> pa.Table:
        """A batch's distinct grams and words by shard, with how often they are in training texts."""
        parts, held, size = [], [], 0
        heard, others, texts = Counter(), set(), 0

        def flush() -> None:
            nonlocal held, size
            if held:  # a gram has 48 bits, which leaves one beside it for whether its text trains
                both = np.concatenate([(g << np.uint64(1)) | np.uint64(bool(t)) for g, t in held])
                both.sort()
                keys = both >> np.uint64(1)
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                parts.append((keys[starts], np.add.reduceat((both & np.uint64(1)).astype(np.int64), starts)))
                held, size = [], 0
            if len(parts) > 8:
                parts[:] = [_merged(*(np.concatenate(x) for x in zip(*parts)))]

        for batch in slices(table.to_batches()):
            for text, trains in zip(batch.column("text").to_pylist(), batch.column("trains").to_pylist()):
                words = words_of(text)
                g = grams(words)
                held.append((g, trains))
                size += len(g)
                if trains:
                    heard.update(words)
                    texts += 1
                else:
                    others.update(words)
                if size >= _CHUNK:
                    flush()
        flush()
        me, rows = table.column("batch")[0].as_py(), []
        keys, n = _merged(*(np.concatenate(x) for x in zip(*parts)))
        at = shard_of(keys, shards)
        for s in np.unique(at):
            rows.append((me, to[int(s)], "grams", _pack_keys(keys[at == s]), _squeeze(n[at == s])))
        by: dict[int, list[bytes]] = {}
        for word in heard.keys() | others:
            by.setdefault(hash_of(word) % shards, []).append(word)
        for s, words in by.items():
            words.sort()
            rows.append((me, to[s], "words", _squeeze(np.frombuffer(b"\n".join(words), np.uint8)),
                         _squeeze(np.array([heard[w] for w in words], np.int64))))
        rows.append((me, to[0], "texts", b"", _squeeze(np.array([texts], np.int64))))
        return _pack_table(rows)
    return count


def hash_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _shard_sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's distinct grams and their training counts."""
    rows = [(k, n) for kind, k, n in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "n"))) if kind == "grams"]
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _merged(np.concatenate([_keys(k) for k, _ in rows]), np.concatenate([_spread(n, "<i8") for _, n in rows]))


def _word_sums(table: pa.Table) -> Counter:
    total: Counter = Counter()
    for kind, k, n in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "n"))):
        if kind == "words":
            for word, c in zip(_spread(k, "u1").tobytes().split(b"\n"), _spread(n, "<i8").tolist()):
                total[word] += c
    return total


def _tops(table: pa.Table) -> pa.Table:
    """What depth 1 and the base need of a shard: counts by (last byte, byte), the weighted children by
    (last byte, decision), and of its words the training total and how many there are."""
    keys, n = _shard_sums(table)
    words = _word_sums(table)
    texts = sum(int(_spread(x, "<i8")[0]) for kind, x in zip(table.column("kind").to_pylist(), table.column("n").to_pylist()) if kind == "texts")
    rows = [("words", 0, float(sum(words.values()))), ("distinct", 0, float(sum(c > 0 for c in words.values()))), ("texts", 0, float(texts))]
    if len(keys):
        pair, c = _merged(((keys >> np.uint64(8 * DEPTH)) << np.uint64(8)) | (keys & np.uint64(255)), n)
        rows += [("count", int(k), float(x)) for k, x in zip(pair, c)]
        level = grow(keys, n)[2]
        up, w = _merged(((level.keys >> np.uint64(16)) << np.uint64(8)) | (level.keys & np.uint64(255)), level.weighted)
        rows += [("weighted", int(k), float(x)) for k, x in zip(up, w)]
    cols = list(zip(*rows))
    return pa.table({"kind": pa.array(cols[0], pa.string()), "key": pa.array(cols[1], pa.int64()), "x": pa.array(cols[2], pa.float64())})


def _top_levels(counts: dict[int, float], weighted: dict[int, float]) -> dict[int, Level]:
    """Depths 1 and 0 of the trees, from the shards' sums."""
    keys = np.array(sorted(counts), np.uint64)
    n = np.array([counts[int(k)] for k in keys])
    one = Level(keys >> np.uint64(8), keys & np.uint64(255), n)
    up = np.array(sorted(weighted), np.uint64)
    one.mix(up, np.array([weighted[int(k)] for k in up]))
    zero = Level(np.zeros(len(keys), np.uint64), keys & np.uint64(255), n)
    zero.mix(one.keys & np.uint64(255), one.weighted)
    return {0: zero, 1: one}


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, trains, n_tokens, n_known, n_bytes, train_tokens, base_score, score).

    Learns from the rows where ``trains`` is true (null counts as true), all of whose bytes count. Texts are taken
    with A-Z lower-cased and a space for each run of white space, the end coded as one more byte; null
    counts as empty, which still has its end. ``score`` is the log10 probability of the bytes,
    ``base_score`` that of the words and the end by add-one frequencies, ``n_bytes`` the
    bytes coded. Without a training row every decision is even. Repeated rows count and are scored
    each; other columns are ignored.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    to = spread_keys(spark, n)
    rows = rows.withColumn("batch", F.get(F.array(*map(F.lit, to)), F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))).repartition(n, "batch")
    packs = stored(rows.groupBy("batch").applyInArrow(_count_batch(to), _PACK), "packs")

    sums = packs.groupBy("shard").applyInArrow(_tops, "kind string, key long, x double")
    total: dict[str, dict[int, float]] = {k: {} for k in ("words", "distinct", "texts", "count", "weighted")}
    for r in sums.groupBy("kind", "key").agg(F.sum("x").alias("x")).collect():  # at most 2 * 256 * 256 + 3 rows
        total[r["kind"]][r["key"]] = r["x"]
    texts = int(total["texts"].get(0, 0))
    tokens = int(total["words"].get(0, 0)) + texts
    distinct = int(total["distinct"].get(0, 0)) + (texts > 0)
    top = spark.sparkContext.broadcast(_top_levels(total["count"], total["weighted"]))  # 257 contexts
    log_all = math.log10(tokens + distinct + 1)

    def answer(table: pa.Table) -> pa.Table:
        keys, c = _shard_sums(table)
        logs = log10_of(keys, top.value | grow(keys, c)) if len(keys) else np.empty(0)
        words = _word_sums(table)
        out = []
        for batch, shard, what, k, _ in zip(*(table.column(x).to_pylist() for x in ("batch", "shard", "kind", "keys", "n"))):
            if what == "grams":
                out.append((batch, shard, what, k, _squeeze(logs[np.searchsorted(keys, _keys(k))].astype("<f4"))))
            elif what == "words":
                mine = _spread(k, "u1").tobytes().split(b"\n")
                out.append((batch, shard, what, k, _squeeze(np.array([words[w] for w in mine], np.int64))))
        return _pack_table(out)

    answers = packs.groupBy("shard").applyInArrow(answer, _PACK)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, logs, count = [np.empty(0, np.uint64)], [np.empty(0, "<f4")], {}
        for what, k, x in zip(*(right.column(c).to_pylist() for c in ("kind", "keys", "n"))):
            if what == "grams":
                keys.append(_keys(k))
                logs.append(_spread(x, "<f4"))
            else:
                count.update(zip(_spread(k, "u1").tobytes().split(b"\n"), _spread(x, "<i8").tolist()))
        keys, logs = np.concatenate(keys), np.concatenate(logs).astype(float)
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        log_of = {c: math.log10(c + 1) - log_all for c in set(count.values()) | {texts}}
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "n_bytes", "base_score", "score")}
        for batch in slices(left.to_batches()):
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                g = np.sort(grams(words))  # in order they are found faster
                seen = list(map(count.__getitem__, words))
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(words) - seen.count(0) + (texts > 0))
                out["n_bytes"].append(len(g))
                out["base_score"].append(math.fsum(map(log_of.__getitem__, seen)) + log_of[texts])
                out["score"].append(float(logs[np.searchsorted(keys, g)].sum()))
        return pa.table({"id": left.column("id"), "trains": left.column("trains"), **out,
                         "train_tokens": pa.array([tokens] * left.num_rows, pa.int64())}).select(
            ["id", "trains", "n_tokens", "n_known", "n_bytes", "train_tokens", "base_score", "score"])

    shape = f"id {kind}, trains boolean, n_tokens long, n_known long, n_bytes long, train_tokens long, base_score double, score double"
    answers = answers.select(F.col("batch").alias("to"), "kind", "keys", "n")
    return rows.groupBy("batch").cogroup(answers.groupBy("to")).applyInArrow(finish, shape).withColumnRenamed("id", id_col)
