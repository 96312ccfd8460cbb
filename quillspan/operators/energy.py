"""Loudness curves: floors and medians, silences, cut points, loud moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp, count_upto, half_up

EMPTY_DB = -99.0


def dbfs(samples: DataFrame, key: str, t: str, value: str, frame_s: float = 0.02) -> DataFrame:
    """Mean square per frame in decibels, one row a frame up to a key's last; a frame without a sample has -100.

    One partial aggregation, then one row a frame.
    """
    power = F.col(value) * F.col(value)
    frames = samples.groupBy(key, F.floor(F.col(t) / frame_s).cast("int").alias("frame")).agg(F.avg(power).alias("p"))
    spine = frames.groupBy(key).agg(F.max("frame").alias("last")).select(key, F.explode(F.sequence(F.lit(0), "last")).alias("frame"))
    full = spine.join(frames, [key, "frame"], "left")
    return full.select(key, "frame", F.when(F.col("p").isNull(), -100.0).otherwise(10 * F.log10(F.col("p") + 1e-10)).alias("db"))


def levels(energy: DataFrame, key: str) -> DataFrame:
    """Per key: floor (tenth) and median by index, and the silence threshold.

    Frames are counted by (key, db) before the shuffle, so only distinct values of a key are put in order.
    """
    counts = energy.filter(F.col("db") > EMPTY_DB).groupBy(key, "db").agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    upto = F.sum("c").over(w.orderBy("db").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(key, "db", upto.alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("db")))
    found = ranked.groupBy(key).agg(at(0.1).alias("floor_db"), at(0.5).alias("median_db"))
    return found.withColumn(
        "threshold_db", F.greatest(F.lit(-60.0), F.least(F.col("floor_db") + 10, F.col("median_db") - 8))
    )


def silences(energy: DataFrame, key: str, frame_s: float, least_s: float = 0.25) -> DataFrame:
    """Runs of frames below the key's threshold: key, start_s, end_s."""
    w = Window.partitionBy(key).orderBy("frame")
    quiet = energy.join(levels(energy, key).select(key, "threshold_db"), key).filter("db < threshold_db")
    runs = quiet.withColumn("run", F.col("frame") - F.row_number().over(w)).groupBy(key, "run").agg(
        (F.min("frame") * frame_s).alias("a"), ((F.max("frame") + 1) * frame_s).alias("b")
    )
    return runs.filter(F.col("b") - F.col("a") >= least_s).select(key, half_up(F.col("a"), 3).alias("start_s"), half_up(F.col("b"), 3).alias("end_s"))


def plan_cuts(quiet: DataFrame, durations: DataFrame, key: str, target_s: float, search_s: float) -> DataFrame:
    """Cuts about every ``target_s``, each in the longest silence near its place (the first of equals).

    ``durations``: key, duration_s. A fold inside the row; each step finds its few silences by a binary search.
    """
    pauses = quiet.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("pauses"))
    none = F.expr("cast(array() as array<struct<start_s: double, end_s: double>>)")
    rows = durations.join(pauses, key, "left").withColumn("pauses", F.coalesce("pauses", none))
    rows = rows.withColumn("mids", F.transform("pauses", lambda p: (p["start_s"] + p["end_s"]) / 2))
    start = F.struct(F.lit(0.0).alias("last"), F.expr("cast(array() as array<double>)").alias("cuts"))

    def step(s: Column, _: Column) -> Column:
        target = s["last"] + target_s

        def near(p: Column) -> Column:
            mid = (p["start_s"] + p["end_s"]) / 2
            return (mid >= target - search_s) & (mid <= target + search_s) & (mid > s["last"] + target_s * 0.4)

        first = F.greatest(F.lit(1), count_upto(F.col("mids"), target - search_s))
        some = F.slice("pauses", first, F.greatest(F.lit(0), count_upto(F.col("mids"), target + search_s) - first + 1))
        ranked = F.transform(
            F.filter(some, near),
            lambda p: F.struct((p["end_s"] - p["start_s"]).alias("long"), (-p["start_s"]).alias("early"), ((p["start_s"] + p["end_s"]) / 2).alias("mid")),
        )
        cut = F.coalesce(F.array_max(ranked)["mid"], target)
        more = F.col("duration_s") - s["last"] > target_s * 1.25
        return F.struct(
            F.when(more, cut).otherwise(s["last"]).alias("last"),
            F.when(more, F.array_append(s["cuts"], half_up(cut, 3))).otherwise(s["cuts"]).alias("cuts"),
        )

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("duration_s") / (0.4 * target_s)).cast("int")))
    cuts = F.aggregate(steps, start, step, lambda s: s["cuts"])
    return rows.select(key, F.posexplode(cuts).alias("cut", "at_s"))


def moment_energy(energy: DataFrame, moments: DataFrame, key: str, frame_s: float) -> DataFrame:
    """``moments`` (key, moment, start_s, end_s) with the loudness of their loudest tenth over the median, 0 to 1."""
    first, after = F.greatest(F.lit(0), F.floor(F.col("start_s") / frame_s)), F.ceil(F.col("end_s") / frame_s)
    spread = moments.select(key, "moment", F.explode(F.sequence(first.cast("int"), after.cast("int") - 1)).alias("frame"))
    frames = spread.join(energy, [key, "frame"])
    w = Window.partitionBy(key, "moment")
    ranked = frames.select(
        key, "moment", "db", F.count("*").over(w).alias("frames"),
        F.sum((F.col("db") > EMPTY_DB).cast("int")).over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("db"))).alias("r"),
    )
    top = ranked.filter((F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))) & (F.col("db") > EMPTY_DB) & (F.col("frames") >= 10))
    loud = top.groupBy(key, "moment").agg(F.avg("db").alias("loud"))
    found = moments.join(loud, [key, "moment"], "left").join(levels(energy, key).select(key, "median_db"), key, "left")
    score = clamp((F.col("loud") - F.coalesce("median_db", F.lit(-60.0)) - 6) / 12, 0.0, 1.0)
    return found.select(key, "moment", F.when(F.col("loud").isNull(), 0.0).otherwise(score).alias("energy"))
