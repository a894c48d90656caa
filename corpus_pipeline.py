"""From raw documents to token ids: five stages, each written as Parquet and read again.

Language ID, exact dedup, n-gram Jaccard join, mixing sources to target weights, BPE encoding and
decoding. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from helixframe.llm.common import materialize, table
from helixframe.llm.queries import WORD_BPE


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found stay."""
    return language_id.identify_language(docs).filter("lang_kept").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingle similarity of 0.8 or more one stays."""
    return jaccard_join.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that sources weigh as the square roots of their sizes."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document."""
    return bpe.bpe_digests(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("bpe", encode),
]

#: SQL expresses neither the trigram models nor the tokenizer; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
