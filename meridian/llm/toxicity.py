"""Toxicity by nearest labelled examples (operator 2).

A text is a TF-IDF vector over all terms of the labelled examples; a term that tells the labels apart weighs
more (by the root of 1 + its G2), and none is left out. Its score comes from the ``K``
labelled examples of highest cosine, found exactly by an inverted index. The postings of common terms, which
many examples have, are rows of a matrix; their part of a cosine is a product for many texts at once. The other
terms' postings are few, and all are added up.
Neighbours vote by distance; an isotonic fit of the examples' own leave-one-out votes makes the
vote a probability. The nearest examples are returned as evidence.

Fitted on at most ``MOST_EXAMPLES`` examples of each label; document frequencies count all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import appended, release_memory, releasing, sampled_labels, shuffle_partitions, slices, stored

MOST_EXAMPLES = 4096
K, EVIDENCE = 15, 3
COMMON = 16   # a term that one example in so many has is common
TEXTS = 128   # texts that are multiplied at once
_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))  # ASCII that no word has: a space


def _words(text: str | None) -> list[str]:
    """All matches of _WORD in the lower-cased text; where what stands between spaces is letters only, without ``re``."""
    text = (text or "").lower().encode("utf-8", "surrogatepass").translate(_NO_LETTERS).decode("utf-8", "surrogatepass")
    found = text.split()
    return found if text.isascii() or all(map(str.isalpha, found)) else _WORD.findall(text)


def words(text: str | None) -> Counter:
    return Counter(_words(text))


def _places(names: pa.Array, words: list[str] | pa.Array) -> np.ndarray:
    """Each word's place among the distinct names, -1 if it is none. The names are looked up among the words: those are
    fewer, and so no hash table of all names is held."""
    coded = (words if isinstance(words, pa.Array) else pa.array(words, pa.string())).dictionary_encode()
    at = pc.index_in(names, coded.dictionary)
    place = np.full(len(coded.dictionary), -1)
    place[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return place[coded.indices.to_numpy()]


def _ranges(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges low .. high - 1 on end, and the length of each range."""
    n = highs - lows
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lows - ends + n, n), n


@dataclass
class Examples:
    """Labelled examples: the terms of example i, and how often it has them, at ends[i] .. ends[i + 1] - 1."""

    ids: np.ndarray
    labels: np.ndarray
    ends: np.ndarray
    terms: np.ndarray            # numbers of
    names: pa.Array              # strings, ascending
    counts: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> "Examples":
        """Of a table (id, label, term: list of strings, n: list of integers)."""
        term = rows.column("term").combine_chunks()
        names = term.flatten().unique()
        names = names.take(pc.array_sort_indices(names))
        places = pa.ListArray.from_arrays(term.offsets, pa.array(_places(names, term.values), pa.int32()))
        return cls.numbered(rows.set_column(rows.column_names.index("term"), "term", places), names)

    @classmethod
    def numbered(cls, rows: pa.Table, names: pa.Array) -> "Examples":
        """Of a table (id, label, term: list of places among the ``names``, which ascend, n: list of integers)."""
        term, n = ([chunk.flatten().to_numpy() for chunk in rows.column(c).chunks] for c in ("term", "n"))
        sizes = pc.list_value_length(rows.column("term")).to_numpy()
        none = np.empty(0, np.int32)
        return cls(rows.column("id").to_numpy(), rows.column("label").to_numpy().astype(float),
                   np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                   np.concatenate([none, *term]).astype(np.int32), names, np.concatenate([none, *n]).astype(np.int32))

    def ordered(self, order: np.ndarray) -> "Examples":
        parts = [slice(a, b) for a, b in zip(self.ends[order], self.ends[order + 1])]
        terms, counts = (np.concatenate([v[:0], *(v[part] for part in parts)]) for v in (self.terms, self.counts))
        ends = np.concatenate([[0], np.cumsum(np.diff(self.ends)[order])]).astype(np.int64)
        return Examples(self.ids[order], self.labels[order], ends, terms, self.names, counts)


@dataclass
class Index:
    """Example vectors as postings by term."""

    ids: np.ndarray
    labels: np.ndarray
    rates: np.ndarray            # training rows that an example stands for
    names: pa.Array              # of the terms
    idf: np.ndarray              # of each term, and the examples of each label that have it:
    with_1: np.ndarray
    with_0: np.ndarray
    prior: float
    starts: np.ndarray           # of each term and the end, into:
    where: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def __post_init__(self):
        self.have = (int((self.labels == 0).sum()), int((self.labels == 1).sum()))
        self.scale = _scale(self.idf, self.with_1, self.with_0, self.have)

    @property
    def terms(self) -> list[str]:
        return self.names.to_pylist()

    def vector(self, found: dict[str, int], label: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of term counts: sorted terms, weights. With the ``label`` of an example, its terms weigh
        as if it had not been counted for them."""
        return self.vectors([found], [label])[0]

    def vectors(self, found: list[dict[str, int]], labels: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        places = _places(self.names, list(chain.from_iterable(found)))
        numbers = np.fromiter(chain.from_iterable(f.values() for f in found), float, len(places))
        ends = np.cumsum([0, *map(len, found)])
        return [self._vector(places[a:b], numbers[a:b], label) for a, b, label in zip(ends, ends[1:], labels or [None] * len(found))]

    def _vector(self, at: np.ndarray, counts: np.ndarray, label: int | None) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0):]
        at = at[order]
        if label is None:
            return at, _unit(self.scale[at], counts[order])
        have = (self.have[0] - (label == 0), self.have[1] - (label == 1))
        scale = _scale(self.idf[at], self.with_1[at] - (label == 1), self.with_0[at] - (label == 0), have)
        return at, _unit(scale, counts[order])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "rows")}

    def _common(self) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row in the matrix of common terms' weights by example (-1: it has none), and the matrix."""
        if "rows" not in self.__dict__:
            n = len(self.labels)
            ends = self.starts
            common = np.flatnonzero(np.diff(ends) * COMMON >= n) if n else np.empty(0, np.int64)
            self.slot = np.full(len(self.names), -1)
            self.slot[common] = np.arange(len(common))
            self.rows = np.zeros((len(common), n))
            for i, t in enumerate(common):
                self.rows[i, self.where[ends[t]:ends[t + 1]]] = self.weights[ends[t]:ends[t + 1]]
        return self.slot, self.rows

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Of each vector the K examples of highest positive cosine (ties: smaller place), but for its example in ``skip``."""
        found, n = [], len(self.labels)
        if not n:
            return [[] for _ in vectors]
        slot, rows = self._common()
        for low in range(0, len(vectors), TEXTS):
            some = vectors[low:low + TEXTS]
            queries = np.zeros((len(some), len(rows)))
            for q, (at, w) in zip(queries, some):
                is_common = slot[at] >= 0
                q[slot[at[is_common]]] = w[is_common]
            parts = queries @ rows
            for i, (at, w) in enumerate(some):
                rare = slot[at] < 0
                found.append(self._best(parts[i], at[rare], w[rare], -1 if skip is None else skip[low + i]))
        return found

    def _best(self, part: np.ndarray, at: np.ndarray, w: np.ndarray, skip: int) -> list[tuple[float, int]]:
        """The K best of one text, given its common terms' part of the cosines and its other terms."""
        postings, n = _ranges(self.starts[at], self.starts[at + 1])
        cos = part + np.bincount(self.where[postings], np.repeat(w, n) * self.weights[postings], len(part))
        if skip >= 0:
            cos[skip] = 0.0
        least = np.partition(cos, -K)[-K] - 1e-9 if len(cos) > K else 0.0
        near = np.flatnonzero((cos >= least) & (cos > 0))
        cos = np.round(cos[near], 12)
        order = np.lexsort((near, -cos))[:K]
        return [(float(cos[i]), int(near[i])) for i in order]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, by nearness and rate, with the prior as one far neighbour."""
        i = np.array([p[1] for p in near], np.int64)
        votes = self.rates[i] / (1.05 - np.array([p[0] for p in near]))
        far = self.rates.mean() if len(self.rates) else 1.0
        return float(((votes * self.labels[i]).sum() + far * self.prior) / (votes.sum() + far))

    def score(self, vote: float) -> float:
        return min(1.0, max(0.0, 0.98 * float(np.interp(vote, *self.curve)) + 0.02 * vote))


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted increasing fit of y by x: knots at the pooled blocks' means."""
    pools: list[list[float]] = []
    for value in np.unique(x):
        m = x == value
        pools.append([w[m].sum(), (w[m] * y[m]).sum(), (w[m] * x[m]).sum()])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def _unit(scale: np.ndarray, counts: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * scale
    return w / (np.sqrt((w * w).sum()) or 1.0)


def _gain(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G2 of terms that a of n1 and b of n0 examples have: seen against expected, both ways, of both labels."""
    total = np.zeros(len(a))
    for seen, n in ((a, n1), (b, n0)):
        expected = n * (a + b) / max(1, n1 + n0)
        for x, e in ((seen, expected), (n - seen, n - expected)):
            some = x > 0
            total[some] += x[some] * np.log(x[some] / e[some])
    return np.maximum(0.0, 2 * total)


def _scale(idf: np.ndarray, with_1: np.ndarray, with_0: np.ndarray, have: tuple[int, int]) -> np.ndarray:
    return idf * np.sqrt(1 + _gain(with_1, with_0, have[1], have[0]))


def build(examples: Examples, frequency: np.ndarray, n_docs: int, totals: dict[int, int]) -> Index:
    """The index of examples; ``frequency``: documents that have each term; ``totals``: training rows of each label."""
    idf = np.log((1 + n_docs) / (1 + frequency.astype(float))) + 1
    # like vectors side by side; of equal cosines the first counts
    rank = np.empty(len(idf), ">u4")
    rank[np.argsort(-idf, kind="stable")] = np.arange(len(idf))
    keys = [np.sort(rank[examples.terms[a:b]]).tobytes() for a, b in zip(examples.ends, examples.ends[1:])]
    examples = examples.ordered(np.array(sorted(range(len(keys)), key=lambda i: (keys[i], examples.ids[i])), np.int64))
    del keys
    labels, t, n = examples.labels, examples.terms, len(examples.ids)
    have = {y: int((labels == y).sum()) for y in (0, 1)}
    rates = np.array([totals[int(y)] / have[int(y)] for y in labels], float)
    found, with_1 = np.zeros(len(idf), np.int64), np.zeros(len(idf))
    # the postings are the driver's largest arrays: some examples at a time, so that few others are as long
    some = [(low, min(low + TEXTS, n)) for low in range(0, n, TEXTS)]
    for low, high in some:
        part = t[examples.ends[low]:examples.ends[high]]
        np.add.at(found, part, 1)
        np.add.at(with_1, part, np.repeat(labels[low:high], np.diff(examples.ends[low:high + 1])))
    with_0 = found - with_1
    scale = _scale(idf, with_1, with_0, (have[0], have[1]))
    starts = np.concatenate([[0], np.cumsum(found)])
    free, by_example, by_weight = starts[:-1].copy(), np.empty(len(t), np.int32), np.empty(len(t))
    for low, high in some:
        a, b = examples.ends[low], examples.ends[high]
        e = np.repeat(np.arange(high - low), np.diff(examples.ends[low:high + 1]))
        w = (np.log(examples.counts[a:b]) + 1) * scale[t[a:b]]
        norm = np.sqrt(np.bincount(e, w * w, high - low))
        w /= np.where(norm > 0, norm, 1.0)[e]
        order = np.argsort(t[a:b], kind="stable")  # by example within a term, as they stand
        terms, first, many = np.unique(t[a:b][order], return_index=True, return_counts=True)
        to = np.repeat(free[terms] - first, many) + np.arange(b - a)
        by_example[to], by_weight[to] = e[order] + low, w[order]
        free[terms] += many
    return Index(examples.ids, labels, rates, examples.names, idf, with_1, with_0,
                 totals[1] / max(1, totals[0] + totals[1]), starts, by_example, by_weight)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
        most: int = MOST_EXAMPLES, seed: int = 7) -> Index:
    """Fit on the rows of ``docs`` that ``labels`` (id, 0 or 1) marks; see ``sampled_labels`` for what counts."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    picked = F.broadcast(sampled_labels(labels, id_col, label_col, most, seed))
    known = texts.join(picked, "id").withColumn("h", F.xxhash64("text"))
    known = known.groupBy("id", "label").agg(F.min_by("text", "h").alias("text"))

    def count(text: str | None) -> list:
        return [list(words(text).items())]

    known = stored(appended(known, "counts array<struct<term:string,n:int>>", ["text"], lambda: count)
                   .select("id", "label", "counts.term", "counts.n"), "examples")
    names = known.select(F.explode("term").alias("term")).distinct().toArrow().column("term").combine_chunks()
    names = names.take(pc.array_sort_indices(names))
    vocabulary = spark.sparkContext.broadcast(names)  # the terms of at most 2 * most examples

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = batch.column("term")
            at = pa.array(_places(vocabulary.value, term.flatten()), pa.int32())
            ends = np.cumsum([0, *term.value_lengths().to_pylist()], dtype=np.int32)
            yield batch.set_column(2, "term", pa.ListArray.from_arrays(pa.array(ends), at))

    # their terms as numbers: the driver holds each name once
    examples = Examples.numbered(known.mapInArrow(releasing(number), "id long, label int, term array<int>, n array<int>").toArrow(), names)
    del names
    release_memory()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n = vocabulary.value, 0
        found = np.zeros(len(names) + 1, np.int64)  # the last: words that are none
        for batch in slices(batches):
            n += batch.num_rows
            some = Counter(chain.from_iterable(set(_words(text)) for text in batch.column(0).to_pylist()))
            found[_places(names, list(some))] += np.fromiter(some.values(), np.int64, len(some))  # one place, one word
        at = np.flatnonzero(found[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(n, found[at]))], names=["term", "n"])

    counted = texts.select("text").mapInArrow(releasing(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = counted.orderBy("term").toArrow()  # the examples' terms and, first, the count of documents
    vocabulary.destroy()
    n_docs = (counted.column("n")[0].as_py() or 0) if counted.num_rows else 0
    frequency = np.zeros(len(examples.names))
    frequency[counted.column("term").to_numpy()[1:]] = counted.column("n").to_numpy()[1:]
    totals = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    totals = {int(r["y"]): r["count"] for r in totals.groupBy("y").count().collect()}
    index = build(examples, frequency, n_docs, {y: totals.get(y, 0) for y in (0, 1)})
    del examples, counted, frequency
    release_memory()
    if len(index.ids):
        index.curve = _calibrated(known, index)
    return index


def _calibrated(known: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The curve from votes to shares of label 1: each example's vote by the others, its own label uncounted."""
    shared = known.sparkSession.sparkContext.broadcast(index)  # bounded by the examples

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        place = {int(k): i for i, k in enumerate(index.ids)}
        for batch in batches:
            at = [place[k] for k in batch.column("id").to_pylist()]
            found = [dict(zip(t, n)) for t, n in zip(batch.column("term").to_pylist(), batch.column("n").to_pylist())]
            got = list(map(index.vote, index.nearest(index.vectors(found, [int(index.labels[i]) for i in at]), skip=at)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(got, pa.float64())], names=["place", "vote"])

    # the examples are few, and dealt anew so that all tasks have some
    dealt = known.select("id", "term", "n").repartition(shuffle_partitions(known.sparkSession), "id")
    found = dealt.mapInArrow(releasing(votes), "place long, vote double").toArrow().sort_by("place")
    shared.destroy()
    release_memory()
    return _isotonic(found.column("vote").to_numpy(), index.labels, index.rates)


def score(docs: DataFrame, index: Index, text_col: str = "text", prefix: str = "toxicity") -> DataFrame:
    """``docs`` with ``<prefix>_score`` (double, 0 to 1) and ``<prefix>_evidence``: the nearest
    examples as (id, similarity, label). Null and empty texts, and texts without a known term, have no
    neighbours and the score of the prior; with no examples at all every score is that of an
    empty vote. Only the text is looked at; every row gets a score of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the examples

    def start():
        index, known = shared.value, {}

        def some(texts: list[str | None]) -> list:
            keys = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]  # copies are looked up once
            if len(known) >= 50_000:
                known.clear()
            new = {k: t for k, t in zip(keys, texts) if k not in known}
            for k, near in zip(new, index.nearest(index.vectors([words(t) for t in new.values()]))):
                known[k] = [index.score(index.vote(near)),
                            [{"id": int(index.ids[i]), "similarity": c, "label": int(index.labels[i])} for c, i in near[:EVIDENCE]]]
            return [known[k] for k in keys]
        return some

    kinds = f"{prefix}_score double, {prefix}_evidence array<struct<id:long,similarity:double,label:int>>"
    return appended(docs, kinds, [text_col], start, together=True)
