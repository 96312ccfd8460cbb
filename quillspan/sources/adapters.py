"""The driver's tables as timed entities; each is also given as SQL, for the checks.

``words``: tokens of ``documents`` spread over 0.4 seconds a token by their length. ``spans``: ``events`` from
their time on, as long as their value in seconds. ``energy``: ``events`` of a user in order, one frame each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import let, running
from quillspan.functions.text import NO_BLANK, tokens

SECONDS_PER_WORD = 0.4
#: Seconds of an energy frame, and what is taken off an event's value to make it decibels.
FRAME_S, DB_OFF = 0.1, 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with words: doc_id and its tokens. Narrow: no shuffle."""
    # A filter by the size of the list would be pushed below it and split every text twice.
    spoken = table(spark, sf_dir, "documents").filter(F.col("text").rlike(NO_BLANK))
    return spoken.select("doc_id", tokens(F.col("text")).alias("tokens"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with words: doc_id and the arrays tokens, starts, ends. Narrow: no shuffle."""

    def spread(tokens_: Column) -> Column:
        weights = F.transform(tokens_, lambda w: F.length(w) + 1)
        return let(running(weights, lambda a, b: a + b, "bigint"), lambda upto: let(ends(upto, F.size(tokens_) * SECONDS_PER_WORD), lambda e: times(tokens_, e)))

    def ends(upto: Column, span: Column) -> Column:
        all_ = F.struct(F.get(upto, F.size(upto) - 1).alias("n"), span.alias("span"))
        return let(all_, lambda a: F.transform(upto, lambda n: n / a["n"] * a["span"]))

    def times(tokens_: Column, ends_: Column) -> Column:
        # A word begins where the one before ends, to the last bit.
        starts = F.slice(F.concat(F.array(F.lit(0.0)), ends_), F.lit(1), F.size(ends_))
        return F.struct(tokens_.alias("tokens"), starts.alias("starts"), ends_.alias("ends"))

    return word_lists(spark, sf_dir).select("doc_id", let(F.col("tokens"), spread).alias("_w")).select("doc_id", "_w.*")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, text, start_s, end_s. Narrow: times are made in the document's row."""
    # Outer, as no list is empty: for an inner one Spark adds a filter on the list's size, which makes the list again below.
    each = timed(spark, sf_dir).select("doc_id", F.posexplode_outer(F.arrays_zip("tokens", "starts", "ends")).alias("idx", "w"))
    return each.select("doc_id", "idx", F.col("w.tokens").alias("text"), F.col("w.starts").alias("start_s"), F.col("w.ends").alias("end_s"))


WORDS_SQL = r"""
toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS ts FROM documents
), tw AS (
  SELECT doc_id, i - 1 AS idx, ts[i] AS text, len(ts) AS n, length(ts[i]) + 1 AS w FROM toks, unnest(range(1, len(ts) + 1)) AS t(i)
), words AS (
  SELECT doc_id, idx, text, (sum(w) OVER o - w) / sum(w) OVER (PARTITION BY doc_id) * (n * 0.4::DOUBLE) AS start_s,
    sum(w) OVER o / sum(w) OVER (PARTITION BY doc_id) * (n * 0.4::DOUBLE) AS end_s
  FROM tw WINDOW o AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, start_s, end_s, score, kind."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", start.alias("start_s"), (start + F.col("value")).alias("end_s"),
        F.col("value").alias("score"), F.col("event_type").alias("kind"),
    )


SPANS_SQL = """
spans AS (
  SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS start_s, epoch_us(ts) / 1e6::DOUBLE + value AS end_s,
    value AS score, event_type AS kind FROM events
)"""


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, frame, db."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "user_id", (F.row_number().over(w) - 1).alias("frame"), (F.col("value") - DB_OFF).alias("db")
    )


ENERGY_SQL = """
energy AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value - 100.0::DOUBLE AS db FROM events
)"""
