"""The registered queries opN_<name>: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import bpe, chat, cover_tree, decontaminate, language_model, pieces, quality, ranked, repair, shard, simhash, toxicity, url_filter
from tokenloom.llm.common import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file."""
    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.sharding_report(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_report(table(spark, sf_dir, "pages"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.embedding_report(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_decontamination, op3_chat, op4_url_filter, op5_language_model, op6_quality, op7_simhash, op8_embeddings, op9_bpe, op10_toxicity, op11_ranked_search, op12_pieces, op13_repair)
}
#: SQL cannot express the others: drawn numbers, fitted models, digests of structures that only their own tests can rebuild.
ORACLES = {"op11_ranked_search": ranked.SQL, "op13_repair": repair.SQL}
