"""Media as tables: containers, ranges of samples, frame times, and cuts looked at closely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.spans import mean_difference

# Frames a second that are looked at, and seconds between frames around a cut.
FPS, FINE_S = 3, 0.1


def probed(containers: DataFrame) -> DataFrame:
    """Containers (path, bytes, duration_s, video, audio: track counts) with ``problem``: unreadable, no_video, no_audio or null."""
    problem = (
        F.when(F.col("duration_s").isNull() | (F.col("duration_s") <= 0) | (F.coalesce("bytes", F.lit(0)) <= 0), "unreadable")
        .when(F.coalesce("video", F.lit(0)) == 0, "no_video").when(F.coalesce("audio", F.lit(0)) == 0, "no_audio")
    )
    return containers.withColumn("problem", problem)


def between(samples: DataFrame, t: str, start_s: float, end_s: float, bucket: str | None = None, width: float = 600.0) -> DataFrame:
    """Samples from start to before end; with the table's bucket column its partitions are pruned too. Both filters reach the scan."""
    inside = samples.filter((F.col(t) >= start_s) & (F.col(t) < end_s))
    return inside if bucket is None else inside.filter(F.col(bucket).between(int(start_s // width), int(end_s // width)))


def frame_times(clips: DataFrame, fps: int = FPS) -> DataFrame:
    """Clips (with start_s and end_s) with one row for each frame to look at: frame, t (from the clip's start)."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end_s") - F.col("start_s")) * fps).cast("int"))
    each = clips.withColumn("frame", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("t", F.col("frame") / fps)


def refined_cuts(cuts: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Each cut (key, cut, at_s) moved to where the pictures around it differ most; of equals the first; ``at_s`` where none are there.

    ``frames``: key, t, picture, every 0.1 s around the cuts. Joined over buckets of a second.
    """
    reach = 0.5 / FPS + FINE_S
    near = cuts.withColumn("_b", F.explode(F.sequence(F.floor(F.col("at_s") - reach), F.floor(F.col("at_s") + reach))))
    seen = frames.withColumn("_b", F.floor("t")).join(near, [key, "_b"]).filter(F.abs(F.col("t") - F.col("at_s")) <= reach + 1e-9)
    w = Window.partitionBy(key, "cut").orderBy("t")
    diffs = seen.select(key, "cut", "t", mean_difference(F.col("picture"), F.lag("picture").over(w)).alias("d")).filter("d is not null")
    best = diffs.groupBy(key, "cut").agg(F.max_by("t", F.struct("d", -F.col("t"))).alias("_t"))
    return cuts.join(best, [key, "cut"], "left").withColumn("at_s", F.coalesce(F.col("_t") - FINE_S / 2, "at_s")).drop("_t")


def luma(pixels: Column) -> Column:
    """Grey values of an array of (r, g, b)."""
    return F.transform(pixels, lambda p: F.floor((p["r"] * 3 + p["g"] * 6 + p["b"]) / 10).cast("int"))
