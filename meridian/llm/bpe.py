"""Byte-level BPE encoding and decoding (operator 4).

Distinct words are encoded by Spark higher-order functions: a word is the array of its bytes' ids,
and a fold merges, step by step, the leftmost neighbouring pair whose joined bytes have the lowest
rank, until no pair has one. The ranks are a flat perfect-hash map: one row that is broadcast to the words' rows,
since Spark's driver prints every literal of a plan anew for each step of a job, and keeps the prints.

Documents are dealt into batches by a hash, compressed for their one shuffle, which is planned once and read
twice (Spark reuses the exchange): for the distinct words of each batch, and beside the encoded
words that come back to it. Words meet by a hash of their own in between, so each is folded
once. No word table is broadcast, and a word travels once for each batch that holds it.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from meridian.llm.common import release_memory, releasing, shuffle_partitions, slices, spread_keys

_NO_RANK = 2**31 - 1
#: Cuts a text where no piece of the pattern can span: a word with at most one space before it, or
#: white space. ``re`` counts \x1c-\x1f as white space, the pattern does not; such texts stay whole.
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: (RE2) Texts that are not cut before every space: with white space before one, or odd spaces.
_UNEVEN = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |[\x1c-\x1f]"
_SHIFT, _PRIME = 17, 2**31 - 1
_BLOCK_BYTES = 48_000_000
_WORDS_A_ROW = 5_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file (base64 piece, space, rank; one a line) as piece -> rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def chunks(text: str) -> list[str]:
    return [text] if _ODD_SPACE.search(text) else _COARSE.findall(text)


def cut(texts: pa.Array) -> pa.Array:
    """The chunks of each text, as lists. A space after another sign than white space begins a piece, so a text where
    all are such is cut before each of them; others are cut by ``chunks``."""
    uneven = pc.match_substring_regex(texts, _UNEVEN)
    found = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), " ", "\x1c "), "\x1c")
    if not (odd := uneven.to_numpy(zero_copy_only=False)).any():
        return found
    at = np.arange(len(texts))
    at[odd] = len(texts) + np.arange(odd.sum())
    return pa.concat_arrays([found, pa.array(map(chunks, texts.filter(uneven).to_pylist()), found.type)]).take(pa.array(at))


def _joined(parts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Binary values on end: parts ends[i] .. ends[i + 1] - 1 are value i. Fails if a part is null."""
    if parts.null_count:
        raise ValueError("a piece without ids")
    at = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(), dtype=np.int64)])[ends]
    data = parts.buffers()[2] or b""  # all of them, as ``take`` gives them
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])


def rank_map(ranks: dict[bytes, int]) -> tuple[pa.Table, Callable[[Column, Column, Column], Column]]:
    """The ranks as one row ``table``, and the look-up in it.

    ``table`` is a struct of two flat arrays, a perfect hash of every pair of ids whose joined
    bytes have a rank: a pair's key a * 2**17 + b picks a multiplier, which with the key picks the
    slot that holds key * 2**17 + rank. ``look(table, a, b)`` is the rank, or _NO_RANK.
    """
    pairs = {(ranks[p[:i]] << _SHIFT) + ranks[p[i:]]: rank for p, rank in ranks.items()
             for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
    groups, size = max(1, len(pairs) // 3), len(pairs) * 5 // 4 + 1
    slots, multipliers = np.full(size, -1, np.int64), np.zeros(groups, np.int64)
    keys = np.array(sorted(pairs, key=lambda k: k % groups), np.int64)
    parts = np.split(keys, np.flatnonzero(np.diff(keys % groups)) + 1) if len(keys) else []
    for part in sorted(parts, key=len, reverse=True):
        for m in range(1, 1 << 16):
            at = part * m % _PRIME % size
            if (slots[at] < 0).all() and len(np.unique(at)) == len(at):
                break
        else:
            raise ValueError("no multiplier found")
        multipliers[part[0] % groups] = m
        slots[at] = (part << _SHIFT) + [pairs[k] for k in part.tolist()]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (multipliers, slots)]
    table = pa.table({"table": pa.StructArray.from_arrays(lists, names=["m", "s"])})

    def look(t: Column, a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("long"), _SHIFT) + b
        m = F.get(t["m"], (key % groups).cast("int"))
        slot = F.get(t["s"], (key * m % _PRIME % size).cast("int"))
        return F.when(F.shiftright(slot, _SHIFT) == key, slot.bitwiseAND((1 << _SHIFT) - 1).cast("int")).otherwise(_NO_RANK)

    return table, look


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, table: Column, look: Callable[[Column, Column, Column], Column]) -> Column:
    """The ids (array<int>) of a word given as the ids of its bytes, by ranked merges.

    Null gives null, an empty array an empty one. The work grows with the square of a word's length.
    """
    none = F.lit(_NO_RANK)

    def rank(a: Column, b: Column) -> Column:
        return look(table, a, b)

    def state(ids: Column, found: Column) -> Column:
        return _let(found, lambda f: F.struct(ids.alias("ids"), f.alias("ranks"),
                                              F.coalesce(F.array_min(f), none).alias("low")))

    def merge(s: Column) -> Column:
        ids, found, low = s["ids"], s["ranks"], s["low"]

        def at(p: Column) -> Column:  # the pair's place, from 1; before it p - 1 ids, after it from p + 2
            left = F.when(p > 1, F.array(rank(F.get(ids, p - 2), low))).otherwise(F.array().cast("array<int>"))
            right = F.when(p < F.size(found), F.array(rank(low, F.get(ids, p + 1)))).otherwise(F.array().cast("array<int>"))
            return state(F.concat(F.slice(ids, 1, p - 1), F.array(low), F.slice(ids, p + 2, F.size(ids))),
                         F.concat(F.slice(found, 1, F.greatest(p - 2, F.lit(0))), left, right,
                                  F.slice(found, p + 2, F.size(ids))))

        return _let(F.array_position(found, low).cast("int"), at)

    pairs = F.transform(F.slice(word, 2, F.greatest(F.size(word), F.lit(0))), lambda b, i: rank(F.get(word, i), b))
    steps = F.sequence(F.lit(1), F.greatest(F.size(word), F.lit(1)))
    done = F.aggregate(steps, state(word, pairs), lambda s, _: F.when(s["low"] < none, merge(s)).otherwise(s))
    return done["ids"]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian uint32) of every row, each match of ``pattern`` encoded alone.

    Null texts count as empty (no ids), repeated rows come out as often as they go in, null ids are
    kept, other columns are ignored. No special tokens. Texts are never cut; a word of any length
    is one fold. Every single byte must have a rank.
    """
    n = shuffle_partitions(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    byte_ids = [ranks[bytes([b])] for b in range(256)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    to = spread_keys(docs.sparkSession, n)
    rows = rows.withColumn("batch", F.get(F.array(*map(F.lit, to)), F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as compressed blocks of a batch."""
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            at = table.column("batch").to_numpy()
            for b in np.unique(at):
                mine = table.filter(pa.array(at == b)).select(["id", "text"])
                yield _block_row(["batch"], [int(b)], mine)

        for batch in slices(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= _BLOCK_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    dealt = rows.mapInArrow(releasing(deal), "batch int, block binary").repartition(n, "batch")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each batch, by shard."""
        import regex

        seen: dict[int, list[pa.Array]] = {}
        for batch in batches:
            for b, block in zip(batch.column("batch").to_pylist(), batch.column("block")):
                for texts in _unblock(block.as_py()).column("text").chunks:
                    seen.setdefault(b, []).append(cut(texts).flatten().unique())
        find = regex.compile(pattern).findall
        for b, found in seen.items():
            by: dict[int, list[str]] = {}
            for piece in {piece for chunk in pa.chunked_array(found).unique().to_pylist() for piece in find(chunk)}:
                by.setdefault(zlib.crc32(piece.encode()) % n, []).append(piece)
            for shard, pieces in by.items():
                yield _block_row(["batch", "shard"], [b, to[shard]], pa.table({"word": pa.array(sorted(pieces), pa.string())}))

    asked = dealt.mapInArrow(releasing(words), "batch int, shard int, block binary").repartition(n, "shard")

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's distinct words and their bytes' ids, then the blocks that ask for them."""
        ids, names = np.array(byte_ids, np.int32), ["batch", "block", "words", "bytes"]
        blocks = [(b, block) for batch in batches for b, block in zip(batch.column("batch").to_pylist(), batch.column("block").to_pylist())]
        found = pa.chunked_array([_unblock(block).column("word").combine_chunks() for _, block in blocks], pa.string()).unique()
        for i in range(0, len(found), _WORDS_A_ROW):
            some = found.slice(i, _WORDS_A_ROW).take(pa.array(range(min(_WORDS_A_ROW, len(found) - i))))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *pc.binary_length(some).to_pylist()], dtype=np.int32)),
                                             pa.array(ids[np.frombuffer(some.buffers()[2], np.uint8)]))
            one = pa.array([0, len(some)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(one, some),
                                              pa.ListArray.from_arrays(one, lists)], names=names)
        for b, block in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.binary()), pa.nulls(1, pa.list_(pa.string())),
                                              pa.nulls(1, pa.list_(pa.list_(pa.int32())))], names=names)

    sent = asked.mapInArrow(releasing(ahead), "batch int, block binary, words array<string>, bytes array<array<int>>")
    table, look = rank_map(ranks)
    sent = sent.crossJoin(F.broadcast(docs.sparkSession.createDataFrame(table)))  # one row, of the vocabulary's size
    del table
    release_memory()  # of the pairs as well
    folded = _let(F.col("table"), lambda t: F.transform("bytes", lambda w: fold_merges(w, t, look)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, askers, asked = [], [], [], []
        for batch in slices(batches, 1):
            if (words := batch.column("words")[0]).is_valid:
                coded = batch.column("ids")[0].values
                data = coded.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                ends = np.cumsum([0, *coded.value_lengths().to_pylist()], dtype=np.int32) * np.int32(4)
                found.append(words.values)
                ids.append(pa.Array.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]))
            else:
                askers.append(batch.column("batch")[0].as_py())
                asked.append(_unblock(batch.column("block")[0].as_py()).column("word").combine_chunks())
        if not askers:
            return
        ids, at, end = pa.concat_arrays(ids), pc.index_in(pa.concat_arrays(asked), pa.concat_arrays(found)), 0
        for asker, word in zip(askers, asked):
            end += len(word)
            yield _block_row(["asker"], [asker], pa.table({"word": word, "ids": ids.take(at.slice(end - len(word), len(word)))}))

    answers = sent.select("batch", "block", "words", folded.alias("ids")).mapInArrow(releasing(answer), "asker int, block binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        import regex

        find = regex.compile(pattern).findall
        answered = [_unblock(block) for block in right.column("block").to_pylist()]
        words = pa.concat_arrays([pa.array([], pa.string()), *(t.column("word").combine_chunks() for t in answered)])
        ids = pa.concat_arrays([pa.array([], pa.binary()), *(t.column("ids").combine_chunks() for t in answered)]).cast(pa.large_binary())
        blocks = [_unblock(block) for block in left.column("block").to_pylist()]
        lists = [cut(t.column("text").combine_chunks()) for t in blocks]
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        names = coded.dictionary.cast(pa.string())
        # a chunk that is a piece anywhere is cut no further, the others are
        at = pc.index_in(names, words)
        rest = [find(chunk) for chunk in names.filter(at.is_null()).to_pylist()]
        parts = ids.take(pc.index_in(pa.array([piece for pieces in rest for piece in pieces], pa.string()), words))
        ids = pa.concat_arrays([ids, _joined(parts, np.cumsum([0, *map(len, rest)]))])
        whole = at.is_valid().to_numpy(zero_copy_only=False)
        place = np.empty(len(names), np.int64)
        place[whole] = at.drop_null().to_numpy()
        place[~whole] = len(words) + np.arange(len(rest))
        codes, done = coded.indices.to_numpy(), []
        for t, some in zip(blocks, lists):
            ends = some.offsets.to_numpy()
            out = _joined(ids.take(pa.array(place[codes[:ends[-1]]])), ends)
            codes = codes[ends[-1]:]
            done.append(pa.table({"id": t.column("id"), "ids": out.cast(pa.binary())}))
        return pa.concat_tables(done)

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        made = assemble(left, right)
        release_memory()
        return made

    return dealt.groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(
        assembled, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def _block_row(names: list[str], keys: list[int], table: pa.Table) -> pa.RecordBatch:
    """One row: integer keys, and a table as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in keys), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                      names=[*names, "block"])


def _unblock(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``tokens`` with ``out_col`` (binary): the pieces of ``ids_col`` (little-endian uint32) in a row.

    Null ids give null, no ids give no bytes; an id without a piece fails the job.
    """
    pieces = tokens.sparkSession.sparkContext.broadcast({i: p for p, i in ranks.items()})  # a fixed vocabulary
    at = tokens.columns.index(ids_col)
    schema = StructType([*tokens.schema.fields, StructField(out_col, BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = np.empty(max(pieces.value, default=-1) + 1, object)
        for i, p in pieces.value.items():
            piece[i] = p
        for batch in slices(batches):
            out = [None if x is None else b"".join(piece[np.frombuffer(x, "<u4")].tolist())
                   for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, out_col])

    return tokens.mapInArrow(releasing(join), schema)
