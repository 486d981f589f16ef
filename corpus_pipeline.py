"""From raw documents to packed sequences: the stages of a training corpus.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; ``run`` hands each result over as Parquet in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import language_crf, line_rules, mixture_packing, substrings, weighted_minhash
from rowloom.llm.handover import hand_over

#: a text stays if this share of its words is in one language; a third is what chance gives
CLEAR_LANGUAGE = 0.35
#: words whose ids a Python worker keeps: the workers of a stage serve the others too
KEPT_WORDS = 400_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base measures and are not mostly lines of their host."""
    return line_rules.accepted(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a clear language, by a model of this stage's own input."""
    return language_crf.accepted(docs, language_crf.fit(docs), CLEAR_LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return weighted_minhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words that occur elsewhere, with ``n_chars`` of what is left."""
    return substrings.deduplicated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens, mixed by source."""
    return mixture_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), kept_words=KEPT_WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL has no tokenizer and no conditional random field
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = hand_over(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
