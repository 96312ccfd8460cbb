"""Greedy choice among conflicting spans in rounds over written tables, for islands that are too large for one row.

A greedy pass takes spans by rank and keeps one if no kept span is in conflict with it. A span that no better span is in conflict with is kept whatever
else happens, and what it is in conflict with goes: that is a round, and the same follows for what is left. Rounds end when no conflict is left; there are
as many as the longest chain of conflicts of falling rank, a few dozen for ranks in no order of time. No task holds an island; what is written is the
conflicts, pairs of spans that overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators import intervals
from quillspan.sources import store


def conflicts(spans: DataFrame, keys: list[str], test: Callable[[Column, Column, Column, Column], Column], width_s: float) -> DataFrame:
    """(keys, winner, loser, rank of the winner): pairs of a key whose spans overlap and meet ``test`` of both starts and ends.

    ``spans``: keys, id, start_s, end_s, rank (a struct, unique in its key; the least is the best). Pairs meet in buckets of ``width_s`` seconds.
    """
    side = lambda x: spans.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "start_s", "end_s", "rank")))
    condition = (F.col("rank_a") < F.col("rank_b")) & test(F.col("start_s_a"), F.col("end_s_a"), F.col("start_s_b"), F.col("end_s_b"))
    pairs = intervals.overlap_join(side("a"), side("b"), keys, ("start_s_a", "end_s_a"), ("start_s_b", "end_s_b"), width_s, condition=condition)
    return pairs.select(*keys, F.col("id_a").alias("winner"), F.col("id_b").alias("loser"), F.col("rank_a").alias("rank"))


def dropped(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id) of the spans that a greedy pass drops. ``pairs``: a table of conflicts (read in every round)."""
    left, gone = pairs.select(*keys, "winner", "loser"), None
    while not left.isEmpty():
        beaten = left.select(*keys, F.col("loser").alias("winner")).distinct()
        sure = left.select(*keys, "winner").distinct().join(beaten, [*keys, "winner"], "left_anti")
        now = store.cut(left.join(sure, [*keys, "winner"], "left_semi").select(*keys, F.col("loser").alias("id")).distinct())
        gone = now if gone is None else gone.unionByName(now)
        out = lambda side: now.select(*keys, F.col("id").alias(side))  # noqa: B023, E731
        left = store.cut(left.join(out("loser"), [*keys, "loser"], "left_anti").join(out("winner"), [*keys, "winner"], "left_anti"))
    return pairs.select(*keys, F.col("loser").alias("id")).filter("false") if gone is None else gone


def first_kept(pairs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, by): every dropped span with the best kept one that it is in conflict with."""
    kept = pairs.join(gone.select(*keys, F.col("id").alias("winner")), [*keys, "winner"], "left_anti")
    return kept.groupBy(*keys, F.col("loser").alias("id")).agg(F.min_by("winner", "rank").alias("by"))
