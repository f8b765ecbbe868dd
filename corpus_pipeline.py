"""From raw documents to packed training sequences: each stage reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from silovalue.functions.lineage import scratch_path
from silovalue.llm import mixing, ngram_join, packing, toxicity
from silovalue.llm.common import table


# Workers of the last stage stand beside executors that the earlier ones have filled.
CACHED_WORDS, TEXT_AT_ONCE = 100_000, 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5, by a lexicon learned from the labelled ones among them."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return ngram_join.keep_one(docs, ngram_join.join(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary length with their ids."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=CACHED_WORDS, at_once=TEXT_AT_ONCE))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each_group),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

# No stage but the last could be said in SQL: the first learns a model, the second and third iterate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
