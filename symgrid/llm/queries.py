"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, digest, html, mixing, quality, reputation, secrets, simhash, suffix
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_pairs(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.similar_documents(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(table(spark, sf_dir, "documents"), keep_metrics=True).drop("text", "n_chars")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), keep_scores=True).drop("html")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS, copy_col="copy")


def op9_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.events_from_turns(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_html_extraction, op3_document_fingerprints, op4_secret_scan, op5_quality_rules, op6_url_filter, op7_suffix_array_dedup, op8_source_mixing, op9_bpe_tokens, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality.SQL, "op6_url_filter": reputation.SQL, "op8_source_mixing": mixing.SQL, "op10_chat_format": chat.SQL}
