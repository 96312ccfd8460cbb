"""The corpus pipeline: quality, language, near copies, benchmark passages, then tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its output is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty one with the same columns; further columns, whatever their names, stay as they
are and play no part; very long texts are worked on whole; rows that are alike meet the same decision, except that near copies leave one of
them; equal scores and ties fall as the operators' docstrings say. What a stage makes of a null is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import bpe, decontaminate, language_id, quality, similarity
from quillspan.llm.common import forget, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from ``labels``, predicts to be of quality 1.

    A null text counts as empty and is judged as such; a null doc_id teaches nothing, as no label is joined to it.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; without letters or between two codewords they go.

    A null text has no letters and goes; a null ``lang`` teaches nothing.
    """
    return language_id.kept(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links with a similarity of 0.8 or more over five-word shingles.

    The one with the least doc_id stays; rows of a null or repeated doc_id are told apart by their texts. Null and blank texts are
    nobody's copies and stay.
    """
    return similarity.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark's words; a null text has no words and stays."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, one row a document; a null text has 0 tokens."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokens),
]

#: Trained stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; a stage's table is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir))
        if k:
            forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
