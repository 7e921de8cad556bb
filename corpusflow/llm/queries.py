"""Queries of the operators in this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, contamination, mixing, neardup, quality, repair, secrets, urls
from .alignment import aligned_documents
from .licenses import license_report
from .media import media_features, store
from .neardup import near_duplicates
from .pieces import sample_pieces
from .quality import quality_report
from .tokencounts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store(table(spark, sf_dir, "documents"))).drop("status")


def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(chat.with_probe(table(spark, sf_dir, "conversations")))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5 SQL can follow."""
    return chat.digested(chat.with_probe(table(spark, sf_dir, "conversations")))


def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.url_verdicts(urls.captures_of(pages), urls.entries_of(table(spark, sf_dir, "events"), pages))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_report(table(spark, sf_dir, "conversations"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_sampling": op1_sentencepiece_sampling,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_jpeg_media": op4_jpeg_media,
    "op5_chat_prefix_tree": op5_chat_prefix_tree,
    "chat_digests": chat_digests,
    "op6_weighted_mix": op6_weighted_mix,
    "op7_secret_scan": op7_secret_scan,
    "op8_url_filter": op8_url_filter,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op3_ngram_jaccard_join": neardup.ORACLE_SQL,
    "chat_digests": chat.ORACLE_SQL,
    "op6_weighted_mix": mixing.ORACLE_SQL,
    "op7_secret_scan": secrets.ORACLE_SQL,
    "op8_url_filter": urls.ORACLE_SQL,
    "op11_benchmark_decontamination": contamination.ORACLE_SQL,
    "op12_conversation_repair": repair.ORACLE_SQL,
}
