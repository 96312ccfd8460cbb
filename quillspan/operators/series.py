"""Time series: smoothing, cuts between frames, shots, speaker turns, interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.spans import mean_difference
from quillspan.session import importable

# Fixed values of the smoothing filter: cutoff (Hz), its slope, dead zone (px), speed (px/s).
MIN_CUTOFF, BETA, DEAD_ZONE, MAX_SPEED = 0.6, 0.02, 12.0, 260.0
#: Variance of a mouth's opening below which nobody speaks.
STILL = 0.0005
#: Least difference of two pictures for a cut.
CUT = 0.3


def _alpha(cutoff: float, dt: float) -> float:
    return 1 / (1 + 1 / (2 * math.pi * cutoff) / dt)


class Smoother:
    """A speed-adaptive low-pass, then a dead zone and a speed limit, over one series; five numbers of state."""

    def __init__(self) -> None:
        self.t = self.raw = self.value = self.slope = self.held = None

    def __call__(self, t: float, v: float) -> float:
        dt = t - self.t if self.t is not None else 0.0
        if dt <= 0:
            value = v
        else:
            now = (v - self.raw) / dt
            a = _alpha(1.0, dt)
            self.slope = now if self.slope is None else a * now + (1 - a) * self.slope
            a = _alpha(MIN_CUTOFF + BETA * abs(self.slope), dt)
            value = a * v + (1 - a) * self.value
        if self.held is None:
            self.held = value
        elif abs(far := value - self.held) >= DEAD_ZONE:
            self.held += math.copysign(min(abs(far), MAX_SPEED * max(1e-6, dt)), far)
        self.t, self.raw, self.value = t, v, value
        return self.held


def smoothed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, t, v, ...) with v smoothed along t within a key.

    Sorted rows stream through the tasks and only a key's state is carried, so no key is held, however long it is.
    """
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, Smoother()
        for batch in batches:
            out = []
            names = batch.schema.names
            columns = [batch.column(c).to_pylist() for c in (*keys, "t", "v")]
            for *mine, t, v in zip(*columns, strict=True):
                if mine != key:
                    key, step = mine, Smoother()
                out.append(step(t, v))
            at = names.index("v")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.float64()), *batch.columns[at + 1 :]], names=names)

    typed = rows.withColumn("t", F.col("t").cast("double")).withColumn("v", F.col("v").cast("double"))
    return typed.repartition(*keys).sortWithinPartitions(*keys, "t", "v").mapInArrow(run, typed.schema)


def cuts(frames: DataFrame, key: str, order: str, picture: str, least: float, scale: float = 255.0) -> DataFrame:
    """Frames whose picture differs from the one before by ``least`` and over 2.5 times as much as that did."""
    w = Window.partitionBy(key).orderBy(order)
    diff = frames.select(key, order, mean_difference(F.col(picture), F.lag(picture).over(w), scale).alias("diff"))
    both = diff.withColumn("before", F.coalesce(F.lag("diff").over(w), F.lit(0.0)))
    return both.filter((F.col("diff") >= least) & (F.col("diff") > F.col("before") * 2.5)).select(key, order, "diff")


def cut_times(frames: DataFrame, key: str, t: str, picture: str, least: float = CUT, scale: float = 255.0) -> DataFrame:
    """key, at_s: the middle between two frames where the picture changes abruptly."""
    w = Window.partitionBy(key).orderBy(t)
    diff = frames.select(
        key, ((F.lag(t).over(w) + F.col(t)) / 2).alias("at_s"), F.col(t).alias("_t"), mean_difference(F.col(picture), F.lag(picture).over(w), scale).alias("diff")
    )
    both = diff.withColumn("before", F.coalesce(F.lag("diff").over(Window.partitionBy(key).orderBy("_t")), F.lit(0.0)))
    return both.filter((F.col("diff") >= least) & (F.col("diff") > F.col("before") * 2.5)).select(key, "at_s")


def shots(edges: Column, duration: Column, least: float = 0.8) -> Column:
    """Array of (start, end) between sorted cuts; a shot under ``least`` seconds lengthens the one before."""
    all_edges = F.concat(F.filter(edges, lambda c: (c > 0) & (c < duration)), F.array(duration))
    none = F.expr("cast(array() as array<struct<start: double, end: double>>)")

    def step(s: Column, edge: Column) -> Column:
        n = F.size(s["out"])
        longer = F.array_append(F.slice(s["out"], F.lit(1), n - 1), F.struct(F.try_element_at(s["out"], F.lit(-1))["start"].alias("start"), edge.alias("end")))
        new = F.array_append(s["out"], F.struct(s["at"].alias("start"), edge.alias("end")))
        return F.struct(edge.alias("at"), F.when((n > 0) & (edge - s["at"] < least), longer).otherwise(new).alias("out"))

    return F.aggregate(all_edges, F.struct(F.lit(0.0).alias("at"), none.alias("out")), step, lambda s: s["out"])


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: keys, run, value, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(fresh))
    numbered = marked.withColumn("run", F.sum("_new").over(w) - 1)
    return numbered.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def activity(values: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Population variance of a key's values, null with fewer than ``least``."""
    n = F.count(value)
    return values.groupBy(*keys).agg(F.when(n >= least, F.var_pop(value)).alias("activity"))


def interpolate(frames: Column, t: Column) -> Column:
    """A value at ``t`` between sorted (t, v) key frames, held beyond the ends."""
    before, after = F.filter(frames, lambda k: k["t"] <= t), F.filter(frames, lambda k: k["t"] >= t)
    a, b = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    part = F.when(b["t"] > a["t"], (t - a["t"]) / (b["t"] - a["t"])).otherwise(F.lit(1.0))
    return F.coalesce(a["v"] + (b["v"] - a["v"]) * part, a["v"], b["v"])


def speaker_turns(mouths: DataFrame, clips: DataFrame, least_s: float = 1.6, still: float = STILL) -> DataFrame:
    """Who speaks when: clip, turn, person, start_s, end_s.

    ``mouths``: clip, person, t, mouth; ``clips``: clip, duration_s. Per second, the person whose mouth moves most within
    half a second around it; quiet seconds keep the speaker before (the first, the one after); turns under
    ``least_s`` join the turn before, a short first one the second.
    """
    seconds = clips.select("clip", "duration_s", F.explode(F.sequence(F.lit(0), F.ceil("duration_s").cast("int") - 1)).alias("sec"))
    # A reading counts for its own second and, near an edge, for the neighbour's.
    spread = mouths.select("clip", "person", "mouth", F.explode(F.array_distinct(F.array(F.floor(F.col("t") - 0.5), F.floor("t"), F.floor(F.col("t") + 0.5)))).alias("sec"))
    moves = spread.groupBy("clip", "sec", "person").agg(F.var_pop("mouth").alias("v"), F.count("mouth").alias("n")).filter((F.col("n") >= 2) & (F.col("v") > still))
    best = moves.groupBy("clip", "sec").agg(F.max_by("person", F.struct("v", -F.col("person"))).alias("best"))
    w = Window.partitionBy("clip").orderBy("sec")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = seconds.join(best, ["clip", "sec"], "left").withColumn(
        "person", F.coalesce(F.last("best", ignorenulls=True).over(back), F.first("best", ignorenulls=True).over(ahead))
    )
    turns = runs(filled.filter("person is not null"), ["clip"], "sec", "person").join(clips, "clip")
    timed = F.struct(F.col("first").cast("double").alias("a"), F.least(F.col("last") + 1.0, "duration_s").alias("b"), "person")
    lists = turns.groupBy("clip").agg(F.array_sort(F.collect_list(timed)).alias("t"))

    def join_short(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(last["a"].alias("a"), x["b"].alias("b"), last["person"].alias("person")))
        return F.when((F.size(out) > 0) & ((x["b"] - x["a"] < least_s) | (last["person"] == x["person"])), longer).otherwise(F.array_append(out, x))

    def open_long(out: Column) -> Column:  # a short first turn joins the second
        first, second = F.get(out, F.lit(0)), F.get(out, F.lit(1))
        joined = F.struct(first["a"].alias("a"), second["b"].alias("b"), second["person"].alias("person"))
        short = (F.size(out) > 1) & (first["b"] - first["a"] < least_s)
        return F.when(short, F.concat(F.array(joined), F.slice(out, F.lit(3), F.greatest(F.lit(0), F.size(out) - 2)))).otherwise(out)

    each = lists.select("clip", F.posexplode(F.aggregate("t", F.slice("t", F.lit(1), F.lit(0)), join_short, open_long)).alias("turn", "x"))
    return each.select("clip", "turn", F.col("x.person").alias("person"), F.col("x.a").alias("start_s"), F.col("x.b").alias("end_s"))
