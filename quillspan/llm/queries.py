"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import (
    bpe, chat, decontaminate, html_text, interaction, language_id, media, minhash, periodic, quality, similarity, token_counts, toxicity,
)
from quillspan.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(spark, table(spark, sf_dir, "conversations"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.linked(table(spark, sf_dir, "documents"))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.query(spark, sf_dir)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.query(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_token_counts,
        op3_toxicity,
        op4_chat_formatting,
        op5_html_extraction,
        op6_bpe,
        op7_media_columns,
        op8_language_id,
        op9_quality,
        op10_ngram_jaccard_join,
        op11_filter_interaction,
        op12_periodic_runs,
        op13_minhash_near_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op10_ngram_jaccard_join": similarity.ORACLE_SQL,
    "op11_filter_interaction": interaction.ORACLE_SQL,
    "op13_minhash_near_dedup": minhash.ORACLE_SQL,
}
