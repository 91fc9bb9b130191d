"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, exact_dedup, hyperminhash, language_id, packing, pii, piece_bpe, quality, substring_dedup, vocabulary, warc
from .common import table


def op5_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op1_chroma_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: each vector of ``embeddings`` is played as a recording (``audio.play``)."""
    return audio.align(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.play)


def op2_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), vocabulary.path(vocabulary.PIECES))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), vocabulary.path(vocabulary.PIECES))


def op10_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this folder

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chroma_fingerprint": op1_chroma_fingerprint,
        "op2_fm_substring_dedup": op2_fm_substring_dedup,
        "op3_pii_boosting": op3_pii_boosting,
        "op4_warc_dictionary": op4_warc_dictionary,
        "op5_extendible_hash_dedup": op5_extendible_hash_dedup,
        "op6_nnls_packing": op6_nnls_packing,
        "op7_piece_bpe": op7_piece_bpe,
        "op8_hyperminhash": op8_hyperminhash,
        "op9_language_id": op9_language_id,
        "op10_quality_ftrl": op10_quality_ftrl,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_fm_substring_dedup": substring_dedup.ORACLE,
        "op4_warc_dictionary": warc.ORACLE,
        "op5_extendible_hash_dedup": exact_dedup.ORACLE,
        "op8_hyperminhash": hyperminhash.ORACLE,
    }
