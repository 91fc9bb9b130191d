"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seisframe.llm import common, exact_dedup, hyperminhash, language_id, packing, pii, vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a language that is likelier than all others together."""
    return language_id.keep_identified(docs, vocabulary.path(vocabulary.PIECES))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) keep the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of documents linked by sets of five-word shingles with a similarity of 0.8 or more."""
    return hyperminhash.deduplicate(docs, size=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document's tokens in a packed sequence."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, f"stage-{k}")
    return docs
