"""The corpus pipeline: five stages over ``documents``, each by one of the operators in ``millrace.llm``.

1. language: texts without a language go (null, without letters, or alike to all languages).
2. near_duplicates: one document of each group of near copies stays (five-word shingles, 0.8).
3. decontamination: documents that contain a benchmark item go.
4. secrets: what the scan finds is replaced by ``[SECRET]``; no document goes.
5. tokens: the texts' SentencePiece ids.

All stages but the last return the columns of their input.  Null ids and texts pass as the operators'
docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, language_id, minhash_dedup, secret_scan, sentencepiece_codec
from millrace.llm.common import load, settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.filter_languages(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_checked(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Hashed sketches, lexing and tokenizing are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
