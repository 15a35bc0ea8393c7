"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, language, mixing, near_dedup, tokens
from folio.llm.common import materialise, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what the centroids reject goes."""
    return language.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest doc_id."""
    return near_dedup.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target: a row for each time that a document is taken, the last one of a source cut."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all rows, read back from their files: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_report(docs)


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("tokens", token_output),
]

#: SQL can't express the learned language, MinHash and tokenizer stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
