"""Benchmark decontamination: a prefix-filtered set join of document windows with item windows.

A window is WORDS consecutive words of an item (a shorter item is one window). Its set are its shingles of
SHINGLE words (of a window with fewer words: the whole). A document contains a window only if it contains
all its shingles, so one necessary shingle, the rarest in the documents, is its prefix:

1. A Bloom filter of all item shingles, of bounded size, is tested on every word position of every text.
   What passes, a run of words with all shingles known, is kept as a span; a window lies in one span.
2. Shingles are counted over all spans. A window with a shingle that no document has is gone; the others
   are ordered by rarity and their rarest shingle is the prefix.
3. Span positions join the prefixes. Where the prefix stands in the window gives the place where the window
   would start, which has to lie in the span with its whole length; then the words are compared.

Texts are read once. No list of items is broadcast, only the filter; a shingle that a third of the
documents have is split over the tasks of the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import stored
from meridian.plans.skew import split_join

WORDS, SHINGLE = 10, 5
#: Bits of the Bloom filter for each item shingle, and at most (8 MB).
BITS_EACH, MOST_BITS = 16, 1 << 26

_ONE = np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes in lower case; 0 for those between words: all below 128 but letters and digits.
_BYTE = np.array([c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0
                  for c in range(256)], np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of many texts: ``start`` and ``end`` in ``data``, ``text`` (the text's number), ``hash``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        self.data, ends = _BYTE[raw], offsets - offsets[0]
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = self.data != 0
        edge = inside[1:] != inside[:-1]  # at the byte where a word begins and at that after its last
        new = np.zeros(len(self.data) + 1, bool)
        new[ends] = True  # a text's first byte begins a word of its own
        self.start = np.flatnonzero((edge | new)[:-1] & inside[1:-1])
        self.end = np.flatnonzero((edge | new)[1:] & inside[1:-1]) + 1
        self.text = np.searchsorted(ends, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # of each text
        power = np.full(len(self.data) + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(self.data * power[:-1])])
        back = np.full(len(self.data) + 1, _INVERSE, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        self.hash = _mixed((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of ``size`` words that begin at each word, and whether one text holds all its words."""
        n = max(0, len(self.hash) - size + 1)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = _mixed(h * np.uint64(_BASE) + self.hash[k:k + n])
        return h, self.text[:n] == self.text[size - 1:size - 1 + n]

    def words(self, a: int, b: int) -> list[str]:
        data = self.data
        return [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[a:b], self.end[a:b])]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (item_id, win, size, shingles): distinct windows, their shingles' size and hashes in order."""
    for batch in batches:
        found = Words(batch.column("text"))
        rows = []
        for t, item in enumerate(batch.column("item").to_pylist()):
            a, b = int(found.first[t]), int(found.first[t + 1])
            wide = min(WORDS, b - a)
            for at in range(a, b - wide + 1) if wide else ():
                rows.append((item, found.words(at, at + wide), at))
        hashes = {s: found.shingles(s)[0].astype(np.int64) for s in range(1, SHINGLE + 1)}
        sizes = [min(SHINGLE, len(w)) for _, w, _ in rows]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], batch.column("item").type), pa.array([r[1] for r in rows], pa.list_(pa.string())),
            pa.array(sizes, pa.int32()), pa.array([hashes[s][at:at + len(w) - s + 1] for s, (_, w, at) in zip(sizes, rows)], pa.list_(pa.int64()))],
            names=["item", "win", "size", "shingles"])


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return h & np.uint64(bits - 1), _mixed(h) & np.uint64(bits - 1)


def _filter(windows: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The Bloom filter of all shingles as 64-bit words, and (shingle size, fewest shingles of a window of that size)."""
    found = windows.groupBy("size").agg(F.sum(F.size("shingles")).alias("n"), F.min(F.size("shingles")).alias("least")).collect()
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * sum(r["n"] for r in found)):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("shingles").flatten().to_numpy().astype(np.uint64)
            at = np.unique(np.concatenate(_places(h, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)),
                                              pa.array((_ONE << (at & np.uint64(63))).astype(np.int64))], names=["slot", "mask"])

    made = windows.select("shingles").mapInArrow(run, "slot int, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    made = made.toPandas()  # at most MOST_BITS / 64 rows
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[made["slot"].to_numpy()] = made["mask"].to_numpy().astype(np.uint64)
    return bloom, sorted((r["size"], r["least"]) for r in found)


def _spans(bloom: np.ndarray, sizes: list[tuple[int, int]]):
    """(row, id, text) to (row, id, n_words, spans): runs of words whose shingles all pass the filter."""
    bits = 64 * len(bloom)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string())), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))]))

    def known(h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for place in _places(h, bits):
            ok &= (bloom[place >> np.uint64(6)] >> (place & np.uint64(63)) & _ONE).astype(bool)
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:  # some megabytes of text at a time
                size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(whole.column("text").slice(at)), 0).to_numpy(zero_copy_only=False))
                batch = whole.slice(at, max(1, int(np.searchsorted(size, 4 << 20, "right"))))
                at += batch.num_rows
                found, spans = Words(batch.column("text")), [[] for _ in range(batch.num_rows)]
                for size, least in sizes:
                    h, one = found.shingles(size)
                    ok = np.zeros(len(h) + 2, bool)
                    ok[1:-1] = known(h) & one
                    step = np.diff(ok.astype(np.int8))
                    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
                        # a shingle that runs into the next text is not known, so a run lies in one text
                        if b - a >= least:
                            t = int(found.text[a])
                            spans[t].append({"start": a - int(found.first[t]), "words": found.words(a, b + size - 1), "size": size,
                                             "shingles": h[a:b].astype(np.int64)})
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(np.diff(found.first), pa.int64()),
                                                  pa.array(spans, kind)], names=["row", "id", "n_words", "spans"])
    return run


def _covered(hits: Column) -> Column:
    """Words inside any of the (start, words) ``hits`` of one text."""
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["words"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.sort_array(hits), nothing, add, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_hit, items): its words, those inside an occurrence of an
    item's window, and the ids of the items with windows that occur, as sorted strings.

    Words are runs of letters, digits and all beyond ASCII, A-Z in lower case. Null and empty texts have no words,
    and null and empty items no windows; a null item id is listed as ``null``. Rows that repeat an id are separate
    documents; items that repeat an id are one item. Texts are whole, whatever their length. Other columns are ignored.
    """
    given = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    windows = given.where("text is not null").mapInArrow(_item_windows, "item string, win array<string>, size int, shingles array<long>")
    windows = stored(windows.dropDuplicates(["item", "win"]), "windows")
    bloom, sizes = _filter(windows)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"row long, id {docs.schema[id_col].dataType.simpleString()}, n_words long, spans array<struct<start:int,words:array<string>,size:int,shingles:array<long>>>"
    read = stored(texts.mapInArrow(_spans(bloom, sizes), kind), "spans")

    spans = read.select("row", F.inline("spans"))
    places = spans.select("row", "start", "words", "size", F.posexplode("shingles").alias("at", "shingle"))
    counts = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    needed = windows.select("item", "win", "size", F.size("shingles").alias("all"), F.posexplode("shingles").alias("off", "shingle"))
    ordered = split_join(needed, counts, "shingle", ["item", "win", "off"]).groupBy("item", "win", "all").agg(
        F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "shingle", "off")).alias("rarest"))
    prefixes = stored(ordered.where("found = all").select("item", "win", F.col("rarest.shingle").alias("shingle"), F.col("rarest.off").alias("off")), "prefixes")

    # the words about a place: as many as a window can have before and after it
    around = F.slice("words", F.greatest(F.lit(1), F.col("at") - WORDS + 2), F.lit(2 * WORDS))
    before = F.least(F.col("at"), F.lit(WORDS - 1))
    cut = places.select("row", (F.col("start") + F.col("at")).alias("place"), "shingle", before.alias("before"), around.alias("around"))
    met = split_join(cut, prefixes, "shingle", ["row", "place"])
    met = met.where((F.col("off") <= F.col("before")) & (F.col("before") - F.col("off") + F.size("win") <= F.size("around")))
    met = met.where(F.slice("around", F.col("before") - F.col("off") + 1, F.size("win")) == F.col("win"))
    met = met.select("row", "item", F.struct((F.col("place") - F.col("off")).alias("start"), F.size("win").alias("words")).alias("hit"))

    found = met.groupBy("row", "item").agg(F.collect_set("hit").alias("hits")).groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.sort_array(F.collect_list("item")).alias("items"))
    found = found.select("row", _covered(F.col("hits")).alias("n_hit"), "items")
    out = read.select("row", "id", "n_words").join(found, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))
