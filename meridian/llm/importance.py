"""Quality by importance resampling (operator 7).

Two generative models over hashed word 1- and 2-grams: one of raw text as it comes, counted over the whole
corpus, and one of the target (texts labelled 1), smoothed by the raw one. A document's importance is the product over its n-grams of the
ratio of the two. Documents are resampled without replacement by Gumbel top-k: those with the k
largest sums of log importance and a seeded Gumbel number stay. k is the number of documents that
are target-like by the ratio: those whose share of label 1 * importance is a half or more.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import appended, kth_largest, sampled_labels, slices, stored, uniform

BUCKETS, MOST_EXAMPLES, SMOOTHING = 1 << 14, 20_000, 1.0
#: Weight of the corpus in the target's model, in n-grams a bucket (less for few examples): rare n-grams say little.
PRIOR = 8.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")  # case stays: shouting is a mark of quality too
_CACHE_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[token] = h = zlib.crc32(token.encode())
        return h


def ngrams(text: str | None, hashes: dict) -> np.ndarray:
    """Buckets of the tokens and of the pairs of neighbouring tokens."""
    tokens = _TOKEN.findall(text or "")
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    alone = h * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([alone, pairs]) >> np.uint64(50)).astype(np.int64)  # 14 bits


def _counts(texts: DataFrame) -> np.ndarray:
    """n-grams of all ``texts`` by bucket: added up in each task, then by bucket; BUCKETS rows leave."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(BUCKETS, np.int64), _Hashes()
        for batch in slices(batches):
            found = [ngrams(t, hashes) for t in batch.column(0).to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=BUCKETS) if found else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", most: int = MOST_EXAMPLES, seed: int = 11) -> tuple[np.ndarray, float]:
    """(log ratio by bucket, share of label 1).

    The target model counts at most ``most`` texts of label 1, with the raw model as its Dirichlet prior; the
    raw model counts all of ``docs``. Without a text of label 1 the ratio is 1 and the share 1: all stays.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    totals = {int(r["y"]): r["count"] for r in usable.groupBy("y").count().collect()}
    if not totals.get(1):
        return np.zeros(BUCKETS), 1.0
    picked = sampled_labels(labels, id_col, label_col, most, seed).where("label = 1")  # at most ``most`` ids
    target = _counts(texts.join(F.broadcast(picked), "id").select("text"))
    corpus = _counts(texts.select("text")) + SMOOTHING
    raw = corpus / corpus.sum()
    most_prior, seen = PRIOR * BUCKETS, max(1.0, target.sum())
    p = target + most_prior * seen / (seen + most_prior) * raw  # the prior never outweighs the examples
    return np.log(p / p.sum()) - np.log(raw), totals[1] / sum(totals.values())


def weigh(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", prefix: str = "quality") -> DataFrame:
    """``docs`` with ``<prefix>_ngrams`` and ``<prefix>_log_weight``, the log importance of the whole text.
    Null and empty texts have no n-grams and weight 0, as likely in the target as in the raw text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def start():
        hashes, logs = _Hashes(), shared.value

        def one(text: str | None) -> list:
            found = ngrams(text, hashes)
            return [len(found), float(logs[found].sum())]
        return one

    return appended(docs, f"{prefix}_ngrams long, {prefix}_log_weight double", [text_col], start)


def gumbel_key(weight: Column | str, *keys: Column | str, seed: int = 13) -> Column:
    """Log weight and a Gumbel number that is the same for the same ``keys`` in every run."""
    return F.col(weight) - F.log(-F.log(uniform(*keys, seed=seed)))


def resampled_size(weights: DataFrame, column: str, share: float) -> int:
    """How many documents are more likely of the target than not."""
    return weights.where(F.col(column) + math.log(share) >= math.log(0.5)).count()


def select(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
           text_col: str = "text", seed: int = 13) -> tuple[DataFrame, float | None]:
    """(``docs`` with ``quality_ngrams``, ``quality_log_weight`` and ``quality_key``; the least key that stays).

    Rows that tie at the k-th key all stay, so equal rows (same id and text) share their fate.
    With no documents the threshold is None and nothing is selected.
    """
    ratio, share = fit(docs, labels, label_col, id_col, text_col)
    keyed = weigh(docs, ratio, text_col).withColumn("quality_key", gumbel_key("quality_log_weight", id_col, seed=seed))
    keys = stored(keyed.select("quality_log_weight", "quality_key"), "keys")
    k = resampled_size(keys, "quality_log_weight", share)
    return keyed, kth_largest(keys, "quality_key", k)
