"""Line protocols and framed bodies that arrive in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_lines(chunks: DataFrame, key: str, prefix: str = "data:", complete: bool = False) -> DataFrame:
    """Payloads of complete prefixed lines: key, line, payload. ``chunks``: key, seq, body, cut anywhere.

    A piece of a chunk belongs to the line that so many newlines come before, so lines are put together each by itself and
    a long stream is never one row. What follows its last newline may go on later; of a ``complete`` body it is a line, too, without
    the blanks around it.
    """
    w = Window.partitionBy(key).orderBy("seq")
    newlines = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))
    counted = chunks.select(key, "seq", "body", newlines.alias("_n")).withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    pieces = counted.select(key, "seq", "_before", "_n", F.posexplode(F.split("body", "\n")).alias("_pos", "_piece"))
    # The last piece of a chunk is open; it only begins a line, which has ended if a later chunk ends it.
    ordered = F.array_sort(F.collect_list(F.struct("seq", "_piece")))
    lines = pieces.groupBy(key, (F.col("_before") + F.col("_pos")).alias("_line")).agg(
        F.array_join(F.transform(ordered, lambda c: c["_piece"]), "").alias("_text"), F.max((F.col("_pos") < F.col("_n"))).alias("_ended")
    )
    text = F.when(F.col("_ended"), F.regexp_replace("_text", "\r$", "")).otherwise(F.regexp_replace("_text", r"^\s+|\s+$", ""))
    found = (lines if complete else lines.filter("_ended")).withColumn("_text", text).filter(F.col("_text").startswith(prefix))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_line")) - 1
    return found.select(key, place.alias("line"), F.trim(F.substring("_text", len(prefix) + 1, 1 << 30)).alias("payload"))


#: The fields of an event, and the payload after which nothing counts.
EVENT = (
    "struct<choices: array<struct<delta: struct<content: string>, finish_reason: string>>, "
    "usage: struct<prompt_tokens: long, completion_tokens: long>>"
)
DONE = "[DONE]"


def completion_events(lines: DataFrame, key: str) -> DataFrame:
    """key, line, content, finish, usage of the payloads (key, line, payload) before the end mark; unreadable ones say nothing."""
    # Lines of a key are together already, so the window moves nothing, and the lines are not made a second time for a join.
    end = F.min(F.when(F.col("payload") == DONE, F.col("line"))).over(Window.partitionBy(key))
    before = lines.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("line") < F.col("_end")))
    read = before.select(key, "line", F.from_json("payload", EVENT).alias("e"))
    choice = F.get("e.choices", F.lit(0))
    filled = lambda c: F.when(c != "", c)
    return read.select(key, "line", filled(choice["delta"]["content"]).alias("content"), filled(choice["finish_reason"]).alias("finish"), F.col("e.usage").alias("usage"))


def deltas(events: DataFrame, key: str) -> DataFrame:
    """Folds the events of a stream: key, text, finish and, if events have usage, the last of it. ``events``: key, line, content, finish."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "content")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    return events.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda x: F.coalesce(x["content"], F.lit(""))), "").alias("text"),
        *(last(c) for c in ("finish", "usage") if c in events.columns),
    )


def framed(parts: DataFrame, bodies: DataFrame, key: str, most: int = 40) -> DataFrame:
    """Cuts a body into its parts: key, part, piece, ok. ``parts``: key, part, length; ``bodies``: key, body.

    A body is ok if it has at most ``most`` parts of positive length that add up to its own.
    """
    w = Window.partitionBy(key)
    begin = F.sum("length").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    sized = parts.select(
        key, "part", "length", begin.alias("begin"), F.sum("length").over(w).alias("total"),
        F.min("length").over(w).alias("least"), F.count("*").over(w).alias("n"),
    )
    ok = (F.col("total") == F.length("body")) & (F.col("least") > 0) & (F.col("n") <= most)
    piece = F.expr("substring(body, cast(begin + 1 as int), cast(length as int))")
    return sized.join(bodies, key).select(key, "part", F.when(ok, piece).alias("piece"), ok.alias("ok"))
