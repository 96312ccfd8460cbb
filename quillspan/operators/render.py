"""Render plans: clips cut at every border of their layers, and what moves inside a piece."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.functions.numbers import clamp
from quillspan.operators import intervals
from quillspan.session import importable

# How far a still shot is pushed in, the least length for it, where it is pushed to, the least length of a word.
PUNCH_IN, PUNCH_IN_MIN_S, PUNCH_UP, LEAST_WORD_S = 0.06, 4.0, 0.4, 0.05
#: Height of a line to its size.
LINE = 1.18
#: Spans and clips of rows that are cut at once.
SPANS = 100_000


def pieces(clips: DataFrame, layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, piece, start_s, end_s and a column for every layer: its value in the piece, null where the layer has none.

    ``clips``: keys, start_s, end_s. ``layers``: name to (keys, start_s, end_s, value); spans of one layer do not overlap within a key, and may
    reach beyond the clip. The pieces tile the clip. A sweep: every span is two marks in time, all layers go through one
    shuffle and one window that carries each layer's last mark; the clip is a layer like the others, and pieces outside of it go.
    """
    every = {"_clip": clips.withColumn("value", F.lit(True)), **layers}

    def marks(name: str, spans: DataFrame, on: bool) -> DataFrame:
        value = F.col("value") if on else F.lit(None).cast(spans.schema["value"].dataType)
        return spans.filter("end_s > start_s").select(*keys, F.col("start_s" if on else "end_s").alias("_t"), F.lit(on).alias("_on"), F.struct(value.alias("v")).alias(name))

    swept = None
    for name, spans in every.items():
        for on in (False, True):
            one = marks(name, spans, on)
            swept = one if swept is None else swept.unionByName(one, allowMissingColumns=True)
    # Of one time, ends come before starts, so a span that begins where another ends is the one that is carried.
    w = Window.partitionBy(*keys).orderBy("_t", "_on")
    carried = swept.select(*keys, "_t", F.lead("_t").over(w).alias("_next"), *(F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in every))
    cut = carried.filter((F.col("_t") < F.col("_next")) & F.coalesce("_clip.v", F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_t")) - 1
    return cut.select(*keys, place.alias("piece"), F.col("_t").alias("start_s"), F.col("_next").alias("end_s"), *(F.col(f"{n}.v").alias(n) for n in layers))


def layer(starts: Column, ends: Column, values: Column) -> Column:
    """A layer of ``pieces_of``: spans of one row by rising start and without overlaps, as three arrays of one length."""
    return F.struct(starts.alias("starts"), ends.alias("ends"), values.alias("values"))


def pieces_of(rows: DataFrame, keys: list[str], clips: Column, layers: dict[str, Column]) -> DataFrame:
    """``pieces`` of clips whose layers lie in their row, which may hold many clips: keys, clip, piece, start_s, end_s and a column for every layer.

    ``clips``: an array of (clip, start_s, end_s), which may overlap. ``layers``: name to ``layer``. Nothing is shuffled; Arrow batches are cut
    by binary searches, some thousands of spans at a time, so memory grows with a batch of rows and not with its pieces.
    """
    importable(rows.sparkSession)
    held = rows.select(*keys, clips.alias("_clips"), *(x.alias(n) for n, x in layers.items()))
    kinds = {f.name: f.dataType for f in held.schema}
    schema = StructType([f for f in held.schema if f.name in keys]).add("clip", kinds["_clips"].elementType["clip"].dataType)
    schema = schema.add("piece", "integer").add("start_s", "double").add("end_s", "double")
    names = list(layers)
    for n in names:
        schema = schema.add(n, kinds[n]["values"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = sum(_sizes(batch.column(n).field("starts")) for n in names) + _sizes(batch.column("_clips"))
            part = np.cumsum(spans) // SPANS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
            for first, upto in pairwise(edges):
                yield _cut(batch.slice(first, upto - first), keys, names)

    return held.mapInArrow(run, schema)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of every value, and the values."""
    return np.repeat(np.arange(len(lists)), _sizes(lists)), lists.flatten()


def _within(of: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(of, t) as keys in that order: complex numbers are sorted by their real part first, and hold the times as they are."""
    keys = np.empty(len(t), np.complex128)
    keys.real, keys.imag = of, t
    return keys


def _cut(batch: pa.RecordBatch, keys: list[str], names: list[str]) -> pa.RecordBatch:
    """The pieces of a batch's clips, in order."""
    row, clips = _flat(batch.column("_clips"))
    starts, ends = (clips.field(f).to_numpy(zero_copy_only=False) for f in ("start_s", "end_s"))
    every = np.arange(len(clips))
    layers, borders = {}, [(every, starts), (every, ends)]
    for n in names:
        of, s = _flat(batch.column(n).field("starts"))
        s, e = s.to_numpy(zero_copy_only=False), batch.column(n).field("ends").flatten().to_numpy(zero_copy_only=False)
        long = np.flatnonzero(e > s)
        layers[n] = of, s, e, long = of[long], s[long], e[long], long
        # An end at which the next span begins is a border already.
        last = np.append((of[1:] != of[:-1]) | (s[1:] != e[:-1]), True)[: len(of)]
        for own, t in ((of, s), (of[last], e[last])):
            at = _within(own, t)
            first, upto = np.searchsorted(at, _within(row, starts), "right"), np.searchsorted(at, _within(row, ends), "left")
            size = np.maximum(upto - first, 0)
            borders.append((np.repeat(every, size), t[np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)]))
    clip, t = (np.concatenate(x) for x in zip(*borders, strict=True))
    order = np.lexsort((t, clip))
    clip, t = clip[order], t[order]
    new = np.append(True, (clip[1:] != clip[:-1]) | (t[1:] != t[:-1]))[: len(t)]
    clip, t = clip[new], t[new]
    piece = np.arange(len(clip)) - np.searchsorted(clip, clip)
    cut = np.flatnonzero(clip[1:] == clip[:-1])
    clip, piece, start, end = clip[cut], piece[cut], t[cut], t[cut + 1]
    out = [*(batch.column(k).take(pa.array(row[clip])) for k in keys), clips.field("clip").take(pa.array(clip)), pa.array(piece, pa.int32()), pa.array(start), pa.array(end)]
    sought = _within(row[clip], start)
    for n, (of, s, e, long) in layers.items():
        at = np.searchsorted(_within(of, s), sought, "right") - 1
        on = at >= 0
        on[on] = (of[at[on]] == row[clip][on]) & (start[on] < e[at[on]])
        place = np.zeros(len(at), np.int64)
        place[on] = long[at[on]]
        out.append(batch.column(n).field("values").flatten().take(pa.array(place, mask=~on)))
    return pa.RecordBatch.from_arrays(out, names=[*keys, "clip", "piece", "start_s", "end_s", *names])


def in_clips(spans: DataFrame, clips: DataFrame, key: str, clip: str, width: float) -> DataFrame:
    """Spans (key, start_s, end_s, value) of a whole as a layer of its clips (key, clip, start_s, end_s), which may overlap."""
    bounds = clips.select(key, clip, F.col("start_s").alias("_from"), F.col("end_s").alias("_to"))
    return intervals.overlap_join(spans, bounds, [key], ("start_s", "end_s"), ("_from", "_to"), width).drop("_from", "_to")


def spoken(words: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """When each word (key, idx, grp, start_s, end_s) is the one lit: up to the next word of its caption, the last up to the caption's end (hold_s)."""
    after = F.lead("start_s").over(Window.partitionBy(key, "grp").orderBy("idx"))
    value = F.struct("idx", F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s")).alias("value")
    held = words.withColumn("_after", after).join(groups.select(key, "grp", "hold_s"), [key, "grp"])
    return held.select(key, "start_s", F.coalesce("_after", "hold_s").alias("end_s"), value)


def spoken_of(groups: Column, starts: Column, ends: Column) -> Column:
    """``spoken`` of a transcript in one row, from its caption groups (first, last, hold_s), as a ``layer``."""
    until = F.flatten(F.transform(groups, lambda g: F.concat(F.slice(starts, g["first"] + 2, g["last"] - g["first"]), F.array(g["hold_s"]))))
    each = F.arrays_zip(F.sequence(F.lit(0), F.size(starts) - 1).alias("idx"), starts.alias("from_s"), ends.alias("to_s"))
    return layer(starts, until, each)


def zoom(t: Column, start: Column, end: Column, frames: Column) -> Column:
    """The scale of a crop at ``t``: still shots of four seconds and more are pushed in by up to 6 %; ``frames``: key frames of the shot."""
    still = (F.coalesce(frames, F.lit(0)) <= 1) & (end - start >= PUNCH_IN_MIN_S)
    return F.when(still, 1 - PUNCH_IN * clamp((t - start) / (end - start), 0.0, 1.0)).otherwise(1.0)


def zoomed(rect: Column, scale: Column) -> Column:
    """The crop (x, y, w, h) at a scale, held in the middle across and a little above it."""
    w, h = rect["w"] * scale, rect["h"] * scale
    return F.struct((rect["x"] + (rect["w"] - w) / 2).alias("x"), (rect["y"] + (rect["h"] - h) * PUNCH_UP).alias("y"), w.alias("w"), h.alias("h"))


def progress(t: Column, start: Column, end: Column) -> Column:
    """How much of a word is filled at ``t``, 0 to 1; null without a word."""
    return F.when(start.isNotNull(), clamp((t - start) / F.greatest(F.lit(LEAST_WORD_S), end - start), 0.0, 1.0))


def caption_box(width: Column, height: Column, ratio: Column, lines: Column, margin: Column, safe_top: Column, safe_bottom: Column) -> Column:
    """(size, top, bottom) of a caption in a frame: sizes are made for 9:16; the block stays where no buttons cover it, if it fits."""
    size = F.floor(F.least(height, width * (16 / 9)) * ratio + 0.5)
    block = size * LINE * lines
    bottom = F.least(height * (1 - safe_bottom), F.greatest(height * safe_top + block, height * (1 - margin)))
    return F.struct(size.alias("size"), (bottom - block).alias("top"), bottom.alias("bottom"))
