"""A training corpus from raw documents, in five stages; each works on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import bpe, importance, minhash, mixing, toxicity
from meridian.llm.common import stored
from meridian.llm.queries import MIX_EPOCHS, MIX_LEVELS, MIX_WEIGHTS, TOXIC_AT, training_rows, with_domain

#: The part of all tokens that the mixture takes.
MIX_SHARE = 1.0


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_AT; learned from the training rows of the labels.

    Null and empty texts have no neighbours and the prior as score, so they stay; rows with equal texts stay or go
    together; null and repeated ids are documents like others."""
    labels = _labels(spark, sf_dir)
    index = toxicity.fit(docs, labels.where(training_rows(labels)), "toxic")
    return toxicity.score(docs, index, prefix="toxicity").where(F.col("toxicity_score") < TOXIC_AT).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects. Each row has a key of its text and id, so rows that repeat both
    stay or go together, as do rows without an id that have one text; null and empty texts have no n-gram and compete by
    their key alone. Without labels nothing is selected."""
    keyed, least = importance.select(docs, _labels(spark, sf_dir))
    selected: Column = F.lit(False) if least is None else F.col("quality_key") >= least
    return keyed.where(selected).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id. Documents without words or without an
    id are near to nothing and stay. Rows that repeat the id that stays are told apart by nothing and all stay."""
    found = minhash.near_duplicates(docs)
    return docs.join(found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, each row of a repeated id as often as the most taken one. Null
    levels are a child of their own; documents without words cost nothing and are taken if the order comes to them."""
    weights = mixing.weights_table(spark, MIX_LEVELS, MIX_WEIGHTS)
    taken = mixing.mix(with_domain(docs), MIX_LEVELS, weights, MIX_SHARE, MIX_EPOCHS)
    taken = taken.groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken["id"])).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian uint32), and the hash of what they decode to. A null text has none;
    repeated rows, such as a second epoch's, come out as often as they came in."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return tokens.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids",
                         F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: The stages are models, sketches and merges, which SQL can't express; tests check them instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
