"""The registered queries of the corpus operators: each applies one, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, nbsvm, ogg, secret_scan, sharding, simhash, suffix_dedup, token_counts
from .common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document from one encoding of the whole; a token counts where it begins."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.attribute_tokens(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, "first")


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(read_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score_held_out(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digest(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.mark_contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_ogg_media, op3_secret_scan, op4_suffix_dedup, op5_quality_classifier, op6_byte_bpe, op7_language_id, op8_decontamination, op9_simhash_dedup, op10_balanced_sharding)}

ORACLE_SQL: dict[str, str] = {"op8_decontamination": decontam.ORACLE_SQL}
