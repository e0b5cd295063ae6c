"""Token ids as fixed-width bit-packed blocks (operator 6).

A packed set is a Parquet folder written by Spark's own committer, so it lives in any store Spark
reaches and survives lost executors. One row is one block of whole documents::

    part     int      range of ids the block belongs to; parts are in document order
    first    long     ids of the blocks before this one in its part
    bits     int      width of one id: the fewest bits that hold the vocabulary
    doc_ids  binary   little-endian int64 of each document (0 where the id is null)
    nulls    binary   one byte a document, 1 where the id is null
    offsets  binary   little-endian int64, documents + 1: first id of each document in the block
    data     binary   the ids, ``bits`` bits each, least significant bit first

A document's ids start at bit ``offsets[i] * bits`` of ``data``; ``unpack`` reads any range of ids
without touching the rest. Documents are in ascending id order (null first; equal ids by a hash
of their text), null texts count as empty, every document ends in ``end_id``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.llm.common import slices

BLOCK_IDS = 1 << 16
SCHEMA = "part int, first long, bits int, n_ids long, doc_ids binary, nulls binary, offsets binary, data binary"
#: str.split() also splits at these, the tokenizer's white space does not hold them.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_CACHE_WORDS = 500_000


def width(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned integers below 2**bits) as packed bits, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    ids = ids.astype(np.uint64)
    spread = ((ids[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids start .. stop - 1 of packed ``data``, as uint32; reads only their bytes."""
    if bits in (8, 16, 32):
        step = bits // 8
        return np.frombuffer(data, f"<u{step}", stop - start, start * step).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(data, np.uint8, (stop * bits + 7) // 8 - first, first)
    spread = np.unpackbits(raw, bitorder="little")[start * bits - first * 8:][:(stop - start) * bits]
    weights = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    return spread.reshape(-1, bits).astype(np.uint32) @ weights


class WordIds(dict):
    """White-space separated chunk -> its ids as little-endian uint32 bytes, found once per chunk.

    For a tokenizer that lower-cases, splits by a pattern and drops white space, a text's ids are
    its chunks' ids in order, and a plain chunk's ids (ASCII and Latin-1 letters, where both
    sides' rules for case and composition agree) are those of its pieces, straight from the
    library's BPE model. Any other chunk, and any text for another kind of tokenizer, goes
    through the library's whole ``encode``. Caches are emptied when full, which bounds memory only.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.bits = width(self.tokenizer.get_vocab_size(True))
        self.model, self.pieces = self.tokenizer.model, {}
        self.find = _splitter(json.loads(spec))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if (got := self.pieces.get(piece)) is None:
            shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            if len(self.pieces) >= _CACHE_WORDS:
                self.pieces.clear()
            self.pieces[piece] = got = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return got

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            out = b"".join(map(self._piece, self.find(chunk.lower())))
        else:
            out = self._encode(chunk)
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[chunk] = out
        return out

    def text(self, text: str) -> bytes:
        if self.find is None or _ODD_SPACE.search(text):
            return self._encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def _splitter(spec: dict):
    """The tokenizer's own splitting pattern as findall, if it works by chunks; else None."""
    import regex

    try:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        drops = split["behavior"] == "Removed" and split["invert"] and not (level["use_regex"] or level["add_prefix_space"])
        fits = kinds == ["NFC", "Replace", "Lowercase"] and drops and spec["model"]["type"] == "BPE"
        return regex.compile(split["pattern"]["Regex"]).findall if fits else None
    except (KeyError, TypeError, ValueError):
        return None


#: Of the task's process: a worker's next task goes on with what is known.
_KNOWN: dict[str, WordIds] = {}


def _word_ids(spec: str) -> WordIds:
    if spec not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[spec] = WordIds(spec)
    return _KNOWN[spec]


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text with the ``tokenizers`` file ``tokenizer`` and write the packed set ``path``.

    One range shuffle of (id, text) puts the documents in order; each task streams its range
    through the tokenizer into blocks of about ``block_ids`` ids (a longer document has a
    block of its own). Input columns other than the two named ones are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast(spec)  # the vocabulary file: its size is fixed

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _word_ids(shared.value), TaskContext.get().partitionId()
        bits = words.bits
        end = np.array([end_id], "<u4").tobytes()
        first, keys, nulls, offsets, parts = 0, [], [], [0], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [part, first, bits, len(ids), np.array(keys, "<i8").tobytes(),
                   np.array(nulls, np.uint8).tobytes(), np.array(offsets, "<i8").tobytes(), pack(ids, bits)]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.append(words.text(text or "") + end)
                keys.append(key or 0)
                nulls.append(key is None)
                offsets.append(offsets[-1] + len(parts[-1]) // 4)
                if offsets[-1] >= block_ids:
                    yield flush()
                    first, keys, nulls, offsets, parts = first + offsets[-1], [], [], [0], []
        if keys:
            yield flush()

    order = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = order.withColumn("tie", F.xxhash64("text"))
    order = order.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    order.mapInArrow(encode, SCHEMA).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """A packed set as (doc_id, start long, n_tokens long, ids binary: little-endian uint32).

    ``start`` counts the ids of all documents before. Its base per part comes from a sum per
    part, one row for each write task, so its broadcast is bounded by the number of parts.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = blocks.join(F.broadcast(parts), "part").select(
        (F.col("base") + F.col("first")).alias("first"), "bits", "doc_ids", "nulls", "offsets", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            first, bits, keys, nulls, offsets, data = (c[0].as_py() for c in batch.columns)
            keys, offsets = np.frombuffer(keys, "<i8"), np.frombuffer(offsets, "<i8")
            ids = [unpack(data, bits, a, b).astype("<u4").tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, mask=np.frombuffer(nulls, np.uint8).astype(bool)), pa.array(offsets[:-1] + first),
                 pa.array(np.diff(offsets)), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
