"""Replies of a speech service: nested results as a table of words in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a reply; times are milliseconds.
REPLY = (
    "struct<results: array<struct<alternatives: array<struct<transcript: string, "
    "words: array<struct<word: string, start_time: double, end_time: double>>>>>>>"
)
_BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def trimmed(text: Column) -> Column:
    """Without blanks of any script at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BLANK}|{_BLANK}$", "")


def recognised(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """One row a reply: keys, text, words (result, text, start_s, end_s), both empty where nothing was heard.

    ``reply`` is JSON text. Of a result only the first alternative by position counts, whatever the others say; a result without one is
    skipped; a time that is missing is 0; blank words and transcripts go. It all stays in the reply's row: no shuffle.
    """
    parsed = replies.select(*keys, F.from_json(reply, REPLY)["results"].alias("_results"))
    first = F.transform(
        F.coalesce("_results", F.expr(f"cast(array() as {REPLY.removeprefix('struct<results: ').removesuffix('>')})")),
        lambda r, place: F.struct(place.alias("result"), F.get(r["alternatives"], F.lit(0)).alias("best")),
    )
    heard = parsed.select(*keys, F.filter(first, lambda r: r["best"].isNotNull()).alias("_heard"))
    texts = F.filter(F.transform("_heard", lambda r: trimmed(r["best"]["transcript"])), lambda t: t != "")
    seconds = lambda t: F.coalesce(t, F.lit(0.0)) / 1000
    words = F.flatten(
        F.transform(
            "_heard",
            lambda r: F.transform(
                F.coalesce(r["best"]["words"], F.expr("cast(array() as array<struct<word: string, start_time: double, end_time: double>>)")),
                lambda w: F.struct(
                    r["result"].alias("result"), trimmed(w["word"]).alias("text"), seconds(w["start_time"]).alias("start_s"), seconds(w["end_time"]).alias("end_s")
                ),
            ),
        )
    )
    return heard.select(*keys, F.array_join(texts, " ").alias("text"), F.filter(words, lambda w: w["text"] != "").alias("words"))


def recognised_words(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """One row a word: keys, idx (its place in the reply), result, text, start_s, end_s."""
    # Outer and a filter after it: for an inner one Spark adds a filter on the list's size, which reads the reply twice.
    return recognised(replies, keys, reply).select(*keys, F.posexplode_outer("words").alias("idx", "w")).filter("idx is not null").select(*keys, "idx", "w.*")
