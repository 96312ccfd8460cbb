"""Words of padded chunks as a stream: each word once, whatever arrives late or twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owned_stream(heard: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """``speech.owned`` for a stream of words heard in padded chunks, each of them sent at least once.

    ``heard``: key, chunk, idx, start_s, end_s, chunk_start, chunk_end, is_last (the chunk is its key's last), and ``at``, when it was
    sent. A word whose middle lies in another chunk goes at once, without state; the first of (key, chunk, idx) stays, and copies within
    ``late`` of it go. The state of a word is dropped when the watermark has passed it, so state is bounded by what arrives in that time; rows later
    than the watermark are dropped, as every stateful operator does.
    """
    mid = (F.col("start_s") + F.col("end_s")) / 2
    inside = (mid >= F.col("chunk_start")) & ((mid < F.col("chunk_end")) | F.col("is_last"))
    return heard.filter(inside).withWatermark(at, late).dropDuplicatesWithinWatermark([key, "chunk", "idx"]).drop("chunk_start", "chunk_end", "is_last")
