"""The registered queries of the corpus operators, with production parameters, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from silovalue.functions.lineage import scratch_path
from silovalue.llm import (
    byte_bpe, chat_repair, codes, filter_audit, html_cut, licenses, mixing, ngram_join, packing, piece_counts, spotsigs, toxicity, vector_graph,
)
from silovalue.llm.common import table
from silovalue.plans.catalog import query

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


@query("op1_source_mix")
def source_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, directory, "documents")))


@query("op2_binary_packing")
def binary_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, directory, "documents"), public_tokenizers.path(BYTE_BPE)))


@query("op3_addressable_codes")
def addressable_codes(spark: SparkSession, directory: str) -> DataFrame:
    path = scratch_path(spark, "codes")
    codes.write(table(spark, directory, "documents"), path, public_tokenizers.path(WORD_BPE))
    return codes.digest(codes.read(spark, path))


@query("op4_toxicity")
def toxic_documents(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return toxicity.digest(documents, toxicity.fit(documents, table(spark, directory, "labels")))


@query("op5_ngram_join")
def shingle_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.join(table(spark, directory, "documents"))


@query("op6_spot_signatures")
def spot_signatures(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return spotsigs.edit_study(documents, spotsigs.common_words(documents))


@query("op7_vector_graph")
def near_vectors(spark: SparkSession, directory: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, directory, "embeddings"))


@query("op8_license_scan")
def license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan(table(spark, directory, "documents"))


@query("op9_page_text")
def page_text(spark: SparkSession, directory: str) -> DataFrame:
    return html_cut.extract(table(spark, directory, "pages"))


@query("op10_piece_counts")
def piece_lengths(spark: SparkSession, directory: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, directory, "documents"), public_tokenizers.path(WORD_BPE))


@query("op11_byte_bpe")
def byte_pair_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    rows = byte_bpe.round_trip(table(spark, directory, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return byte_bpe.digest(rows)


@query("op12_filter_audit", filter_audit.audit_sql())
def filter_interactions(spark: SparkSession, directory: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, directory, "documents"), table(spark, directory, "labels")))


@query("op13_chat_repair", chat_repair.REPAIR_SQL)
def conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    return chat_repair.report(chat_repair.damage(table(spark, directory, "conversations")))
