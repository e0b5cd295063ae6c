"""What the driver of the training-data operators holds: bounded, however often they run in one session."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql.classic.dataframe import DataFrame

from meridian.llm import bpe, toxicity
from tests.llm.edge import docs


def test_the_ranks_are_no_text_of_the_plan(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.encode(docs(spark, [(1, "some words")]), ranks, public_tokenizers.PATTERN)
    assert len(tokens._jdf.queryExecution().toString()) < 200_000


def test_each_term_of_the_examples_reaches_the_driver_once(spark, monkeypatch):
    rows = [(i, "aa bb cc " + "x" * (i + 1)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    found, collect = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: found.append(collect(self)) or found[-1])
    index = toxicity.fit(docs(spark, rows), labels, "toxic")
    columns = [c.combine_chunks() for t in found for c in t.columns]
    texts = [c.flatten() if pa.types.is_list(c.type) else c for c in columns]
    texts = [v for c in texts if pa.types.is_string(c.type) for v in c.to_pylist()]
    assert sorted(texts) == index.terms == sorted({w for _, text in rows for w in text.split()})


def test_postings_are_built_beside_few_others_of_their_length():
    rng = np.random.RandomState(1)
    names = pa.array([f"t{i:05}" for i in range(5000)])
    lists = [np.sort(rng.choice(5000, 500, replace=False)).astype(np.int32) for _ in range(2000)]
    table = pa.table({"id": range(2000), "label": rng.randint(0, 2, 2000), "term": pa.array(lists, pa.list_(pa.int32())),
                      "n": pa.array([np.ones(500, np.int32)] * 2000, pa.list_(pa.int32()))})
    examples = toxicity.Examples.numbered(table, names)
    tracemalloc.start()
    index = toxicity.build(examples, np.ones(5000), 9000, {0: 3000, 1: 3000})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.where) == 1_000_000 and peak < 32 * len(index.where)  # bytes a posting; 12 are kept
