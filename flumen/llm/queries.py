"""The operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, jaccard, language_id, licenses, pii, quality_classifier, quality_rules, url_reputation
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(read_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_conversations(read_table(spark, sf_dir, "conversations"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(read_table(spark, sf_dir, "documents"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_license_scan, op4_ngram_jaccard, op5_decontaminate, op6_bpe, op7_pii, op8_url_reputation, op9_quality_rules, op10_quality_classifier)}
ORACLES = {"op2_chat_format": chat.ORACLE, "op8_url_reputation": url_reputation.oracle(), "op9_quality_rules": quality_rules.ORACLE, "op3_license_scan": licenses.oracle(), "op5_decontaminate": decontaminate.ORACLE}
