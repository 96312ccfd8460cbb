"""What a review screen asks of jobs and clips: runners-up, prominence, progress, time left, positions, wrapped lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp
from quillspan.functions.spans import overlap_of_shorter
from quillspan.operators import intervals

#: Overlap of the shorter clip beyond which a runner-up is the same moment as a pick.
SAME_MOMENT = 0.15
# Share of the whole job at which a stage begins and ends.
STAGES = {"prepare": (0.0, 0.12), "listen": (0.12, 0.35), "choose": (0.35, 0.55), "make": (0.55, 1.0)}


def runners_up(clips: DataFrame, key: str, row: str, picks: int, most: int) -> DataFrame:
    """The ``most`` best clips of a key that share no moment with its ``picks`` best ones.

    ``clips`` has key, row, start_s, end_s, score. The row numbers filter by rank, which Spark limits before the
    shuffle; a key's picks then travel as one short array, joined by the key.
    """
    ranked = Window.partitionBy(key).orderBy(F.desc("score"), "start_s", row)
    best = clips.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= picks)
    chosen = best.groupBy(key).agg(F.collect_list(F.struct("start_s", "end_s", F.col(row).alias("id"))).alias("_chosen"))
    same = F.exists(
        "_chosen",
        lambda c: (c["id"] == F.col(row)) | (overlap_of_shorter(c["start_s"], c["end_s"], F.col("start_s"), F.col("end_s")) > SAME_MOMENT),
    )
    free = clips.join(chosen, key).filter(~same).drop("_chosen")
    return free.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= most)


def prominence(observations: DataFrame, keys: list[str], least_s: float = 0.5, least_rows: int = 3) -> DataFrame:
    """Tracks that last long enough or have enough observations, with mean area times (length + 0.1 s)."""
    span = F.max("t") - F.min("t")
    tracks = observations.groupBy(*keys).agg(F.count("*").alias("n"), span.alias("span_s"), F.avg(F.col("w") * F.col("h")).alias("area"))
    return tracks.filter((F.col("span_s") >= least_s) | (F.col("n") >= least_rows)).withColumn("prominence", F.col("area") * (F.col("span_s") + 0.1))


def overall_progress(stage: Column, fraction: Column) -> Column:
    """A stage's fraction on the scale of the whole job; null for an unknown stage."""
    share = clamp(fraction, 0.0, 1.0)
    value = F.lit(None).cast("double")
    for name, (a, b) in STAGES.items():
        value = F.when(stage == name, a + (b - a) * share).otherwise(value)
    return value


def progress(marks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``marks`` (key, stage, fraction) with a ``progress`` that never falls within a job."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("progress", F.greatest(F.lit(0.0), F.max(overall_progress(F.col("stage"), F.col("fraction"))).over(so_far)))


def seconds_left(elapsed: Column, gained: Column, done: Column) -> Column:
    """At least a minute; null while too little is known: under 0.03 gained or under 20 s."""
    known = (gained >= 0.03) & (elapsed >= 20)
    return F.when(known, F.greatest(F.lit(60.0), elapsed / gained * (1 - done)))


def position_at(points: DataFrame, keyframes: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, t, ...) with ``x`` read from ``keyframes`` (keys, t, x) by linear interpolation.

    Before the first and after the last keyframe its value holds; without keyframes x is 0. Keyframes at one time:
    the largest counts. Both sides as one relation, scanned once forward and once backward on two levels (``intervals.running``).
    """
    frames = keyframes.groupBy(*keys, "t").agg(F.max("x").alias("x"))
    rows = points.withColumn("_k", F.lit(None).cast("struct<t: double, x: double>")).withColumn("_frame", F.lit(False)).unionByName(
        frames.select(*keys, "t", F.struct(F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")).alias("_k"), F.lit(True).alias("_frame")),
        allowMissingColumns=True,
    )
    # Of one time, the frame is before the points for what lies behind, and behind them for what lies ahead.
    behind = intervals.running(rows, keys, "t", [F.col("t"), ~F.col("_frame")], last={"_a": F.col("_k")})
    near = intervals.running(behind, keys, "t", [F.col("t"), F.col("_frame")], last={"_b": F.col("_k")}, backward=True)
    a, b = F.col("_a"), F.col("_b")
    between = F.when(b["t"] > a["t"], a["x"] + (b["x"] - a["x"]) * ((F.col("t") - a["t"]) / (b["t"] - a["t"]))).otherwise(b["x"])
    x = F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b["x"]).when(b.isNull(), a["x"]).otherwise(between)
    return near.filter("not _frame").withColumn("x", x).drop("_k", "_a", "_b", "_frame")


def wrapped(words: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, filled greedily; a longer word has a line of its own."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("lines"), F.lit(None).cast("string").alias("line"))

    def add(at: Column, word: Column) -> Column:
        fits = at["line"].isNull() | (F.length(at["line"]) + 1 + F.length(word) <= width)
        return F.struct(
            F.when(fits, at["lines"]).otherwise(F.array_append(at["lines"], at["line"])).alias("lines"),
            F.when(fits, F.concat_ws(" ", at["line"], word)).otherwise(word).alias("line"),
        )

    def finish(at: Column) -> Column:
        return F.when(at["line"].isNull(), at["lines"]).otherwise(F.array_append(at["lines"], at["line"]))

    return F.aggregate(words, start, add, finish)


def batches(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with the number of their batch of ``size`` within a key, in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def symmetric(asked: DataFrame, answers: DataFrame, a: str, b: str) -> DataFrame:
    """``asked`` pairs with the answers given for them in either orientation."""
    low, high = F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")
    rest = [c for c in answers.columns if c not in (a, b)]
    return asked.select("*", low, high).join(answers.select(low, high, *rest), ["_low", "_high"]).drop("_low", "_high")
