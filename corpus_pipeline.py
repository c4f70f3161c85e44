"""From raw documents to token ids in five stages, each one operator of `agentguard.llm`.

Every stage works on all that the one before kept, is written as Parquet to the shared folder and read
again, so a lost executor repeats part of a stage and never an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agentguard.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from agentguard.llm.queries import table, vocabulary
from agentguard.llm.shared import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at 0.8 similarity of five-word shingles: the smallest doc_id."""
    return ngram_join.keep_one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them: sources weigh 1, 2, 3 in turn, no document comes more than three times."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text they decode to."""
    return bpe.round_trip(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Language models, shingle sets and merges are not SQL: the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
