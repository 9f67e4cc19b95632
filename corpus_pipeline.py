"""Corpus pipeline: language ID, near copies, repeated passages, benchmark leaks, encoding.

Every stage works on all documents that the one before kept. The first four keep the columns of documents; the
last returns doc_id, the number of pieces, the pieces and whether they restore the text. SQL cannot express the
language model or the encoder, so the whole is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.decontaminate import decontaminate
from meshledger.llm.encoding import encode
from meshledger.llm.jaccard import one_of_each
from meshledger.llm.langid import known_language
from meshledger.llm.shared import stage, table
from meshledger.llm.substrings import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return known_language(spark, docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that a document of smaller id repeats."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return encode(docs, ["doc_id"]).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
