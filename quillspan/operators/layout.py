"""Face tracks and the layout of shots: who is where, and which crop, stack or split shows them.

Linking detections is greedy in time: sorted rows pass through an Arrow function that carries the open tracks only. No track
crosses a gap of over 0.8 s, so a clip is cut at such gaps and its parts are linked by themselves. All else is grouped
aggregation, joins over time buckets and column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp
from quillspan.functions.spans import crop_size
from quillspan.operators import series
from quillspan.operators.review import prominence
from quillspan.session import importable

# Linking, framing, face camera.
MAX_GAP_S, LEAST_IOU, REACH = 0.8, 0.25, 1.2
EYE_LINE, LOCK_WIDTH, TOGETHER, STILL_PX = 0.38, 0.55, 0.95, 12.0
CAM_WIDTH, CAM_PRESENCE, CAM_SHARE, CAM_SCALE, STACK_SCALE = 0.16, 0.55, 0.4, 3.6, 3.2
#: Tracks are numbered within a part of a clip, parts by this step; seconds of a bucket of the join with shots.
PART_STEP, BUCKET_S = 1_000_000, 5.0

Box = tuple[float, float, float, float]


def likeness(a: Box, b: Box) -> float:
    """Match points of a track's last box and a box: 1 to 2 by overlap, else 0 to 1 by nearness."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    both = max(0.0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0.0, min(ay + ah, by + bh) - max(ay, by))
    iou = both / max(aw * ah + bw * bh - both, 1e-12)
    if iou >= LEAST_IOU:
        return 1 + iou
    far = math.hypot(ax + aw / 2 - bx - bw / 2, ay + ah / 2 - by - bh / 2)
    return max(0.0, 1 - far / (max(aw, bw) * REACH)) if max(aw, bw) > 0 else 0.0


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a track to rows in order of (clip, part, t, x, y)."""
    key, open_tracks, frame, count = None, [], [], 0  # tracks: [number, t, box]; a frame: (place in the output, t, box)
    out: list[int] = []
    held: list[pa.RecordBatch] = []

    def close_frame() -> None:
        nonlocal open_tracks, count
        if not frame:
            return
        t = frame[0][1]
        open_tracks = [o for o in open_tracks if t - o[1] <= MAX_GAP_S]
        pairs = sorted(
            ((-p, k, j) for k, o in enumerate(open_tracks) for j, f in enumerate(frame) if (p := likeness(o[2], f[2])) > 0)
        )
        tracks, taken = set(), {}
        for _, k, j in pairs:
            if k not in tracks and j not in taken:
                tracks.add(k)
                taken[j] = open_tracks[k]
        for j, (place, _, box) in enumerate(frame):
            track = taken.get(j)
            if track is None:
                track = [count, t, box]
                count += 1
                open_tracks.append(track)
            track[1], track[2] = t, box
            out[place] = key[1] * PART_STEP + track[0]
        frame.clear()

    def finished(n: int) -> pa.RecordBatch:
        done, rest = out[:n], out[n:]
        out[:] = rest
        frame[:] = [(place - n, t, box) for place, t, box in frame]
        return done

    for batch in batches:
        held.append(batch)
        columns = [batch.column(c).to_pylist() for c in ("clip", "part", "t", "x", "y", "w", "h")]
        for clip, part, t, *box in zip(*columns, strict=True):
            if (clip, part) != key:
                close_frame()
                key, open_tracks, count = (clip, part), [], 0
            elif frame and frame[0][1] != t:
                close_frame()
            frame.append((len(out), t, tuple(box)))
            out.append(-1)
        while len(held) > 1 and len(out) - len(frame) >= held[0].num_rows:
            first = held.pop(0)
            yield _with_track(first, finished(first.num_rows))
    close_frame()
    for batch in held:
        yield _with_track(batch, finished(batch.num_rows))


def _with_track(batch: pa.RecordBatch, track: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(track, pa.int64())], names=[*batch.schema.names, "track"])


def tracks(boxes: DataFrame) -> DataFrame:
    """Detections (clip, t, x, y, w, h, and mouth and eye_y if there) with the track of each.

    Sorted rows stream through the tasks, so neither a clip nor a part of it is held; a clip's parts may lie in different tasks.
    """
    importable(boxes.sparkSession)
    kept = [c for c in ("mouth", "eye_y") if c in boxes.columns]
    w = Window.partitionBy("clip").orderBy("t")
    apart = F.coalesce((F.col("t") - F.lag("t").over(w) > MAX_GAP_S).cast("long"), F.lit(0))
    parts = boxes.select("clip", *(F.col(c).cast("double").alias(c) for c in ("t", "x", "y", "w", "h")), *kept).withColumn("_new", apart)
    parts = parts.withColumn("part", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")
    ordered = parts.repartition("clip", "part").sortWithinPartitions("clip", "part", "t", "x", "y")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", track long"
    return ordered.mapInArrow(_link, schema).drop("part")


def prominent(tracked: DataFrame) -> DataFrame:
    """Tracks that last: clip, track, n, span_s, prominence (mean area by duration)."""
    return prominence(tracked, ["clip", "track"])


def in_shots(tracked: DataFrame, shots: DataFrame) -> DataFrame:
    """Detections with the shot they lie in, joined over time buckets. ``shots``: clip, shot, start, end, samples."""
    first, last = F.floor(F.col("start") / BUCKET_S), F.floor(F.col("end") / BUCKET_S)
    spread = shots.withColumn("_bucket", F.explode(F.sequence(first, last)))
    return tracked.withColumn("_bucket", F.floor(F.col("t") / BUCKET_S)).join(spread, ["clip", "_bucket"]).filter("t >= start and t < end").drop("_bucket")


def shots_of(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Shots between the cuts that the pictures show: clip, shot, start, end, samples (frames in the shot, 1 at least).

    ``frames``: clip, t, picture; ``lengths``: clip, duration_s.
    """
    cuts = series.cut_times(frames, "clip", "t", "picture").groupBy("clip").agg(F.array_sort(F.collect_list("at_s")).alias("_cuts"))
    none = F.expr("cast(array() as array<double>)")
    rows = lengths.join(cuts, "clip", "left").select("clip", F.posexplode(series.shots(F.coalesce("_cuts", none), F.col("duration_s"))).alias("shot", "s"))
    spans = rows.select("clip", "shot", "s.start", "s.end")
    seen = in_shots(frames.select("clip", "t"), spans).groupBy("clip", "shot").agg(F.count("*").alias("_n"))
    return spans.join(seen, ["clip", "shot"], "left").select("clip", "shot", "start", "end", F.coalesce("_n", F.lit(1)).alias("samples"))


def presence(inside: DataFrame) -> DataFrame:
    """Per (clip, shot, track) of ``in_shots``: counts, means, extents and how much the mouth moves (null if hardly measured)."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    eye = F.coalesce("eye_y", F.col("y") + F.col("h") * 0.4) if "eye_y" in inside.columns else F.col("y") + F.col("h") * 0.4
    mouth = F.when(F.count("mouth") >= 3, F.var_pop("mouth")) if "mouth" in inside.columns else F.lit(None).cast("double")
    return inside.groupBy("clip", "shot", "start", "end", "samples", "track").agg(
        F.count("*").alias("n"), F.avg("w").alias("mean_w"), F.avg(cx).alias("mean_x"), F.avg(cy).alias("mean_y"), F.avg(eye).alias("eye_y"),
        F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), (F.max(cx) - F.min(cx)).alias("spread"), mouth.alias("activity"),
    ).filter(F.col("n") >= F.greatest(F.lit(2), F.col("samples") * 0.25))


def face_camera(width: int, height: int) -> Column:
    x, y = F.col("mean_x") / width, F.col("mean_y") / height
    edge = (x < 0.3) | (x > 0.7) | (y < 0.3) | (y > 0.7)
    small = F.col("mean_w") <= width * CAM_WIDTH
    return (F.col("n") >= F.col("samples") * CAM_PRESENCE) & small & edge & (F.col("spread") < F.col("mean_w") * 1.5)


def region(width: int, height: int, aspect: float, scale: float) -> Column:
    """A box around a face, as wide as ``scale`` faces, inside the frame."""
    w = F.least(F.lit(float(width)), F.greatest(F.col("mean_w") * scale, F.lit(64.0)))
    w = F.least(w, F.lit(height * aspect))
    h = w / aspect
    x = clamp(F.col("mean_x") - w / 2, F.lit(0.0), width - w)
    return F.struct(x.alias("x"), clamp(F.col("mean_y") - h * 0.42, F.lit(0.0), height - h).alias("y"), w.alias("w"), h.alias("h"))


def plan(tracked: DataFrame, shots: DataFrame, width: int, height: int, allow_split: bool = False) -> DataFrame:
    """One layout per shot: crop at the centre, on a face or on all; following the speaker; split with a face camera; or a stack of two."""
    cw, ch = crop_size(F.lit(width), F.lit(height), 9, 16)
    people = presence(in_shots(tracked, shots)).withColumn("cam", face_camera(width, height) & F.lit(allow_split))
    people = people.withColumn("region", region(width, height, 9 / 16 * 2, STACK_SCALE)).withColumn("cam_region", region(width, height, 9 / 16 / CAM_SHARE, CAM_SCALE))
    one = F.struct((-F.col("n")).alias("order"), "track", "mean_x", "mean_w", "spread", "region")
    seen = people.groupBy("clip", "shot").agg(
        F.count("*").alias("faces"), F.min("left").alias("left"), F.max("right").alias("right"), F.count("activity").alias("measured"),
        F.max("activity").alias("most_active"), F.array_sort(F.collect_list(one)).alias("people"), F.bool_or("cam").alias("cam"),
        F.bool_and(F.col("cam") | (F.col("mean_w") < width * CAM_WIDTH)).alias("all_small"),
        F.min_by("cam_region", F.when(F.col("cam"), F.col("track"))).alias("cam_region"),
    )
    all_shots = shots.select("clip", "shot", "start", "end").join(seen, ["clip", "shot"], "left")
    faces = F.coalesce("faces", F.lit(0))
    first, second = F.get("people", F.lit(0)), F.get("people", F.lit(1))
    together = F.col("right") - F.col("left") <= cw * TOGETHER
    layout = (
        F.when(faces == 0, "centre").when(F.col("cam") & F.col("all_small"), "split").when(faces == 1, "face")
        .when(together, "together").when((F.col("measured") >= 2) & (F.col("most_active") > series.STILL), "speaker").otherwise("stack")
    )
    at = lambda centre: clamp(centre - cw / 2, F.lit(0.0), width - cw)
    x = (
        F.when(layout == "centre", (width - cw) / 2).when(layout == "face", at(first["mean_x"]))
        .when(layout == "together", at((F.col("left") + F.col("right")) / 2))
    )
    locked = F.when(layout == "face", (first["mean_w"] > cw * LOCK_WIDTH) | (first["spread"] < STILL_PX) | (first["order"] > -3)).otherwise(
        ~layout.isin("stack", "speaker")
    )
    left_first = first["mean_x"] <= second["mean_x"]
    stacked = lambda yes: F.when(layout == "stack", F.when(left_first == yes, first["region"]).otherwise(second["region"]))
    return all_shots.select(
        "clip", "shot", "start", "end", layout.alias("layout"), faces.alias("faces"), x.alias("crop_x"), locked.alias("locked"),
        stacked(F.lit(True)).alias("top"), stacked(F.lit(False)).alias("bottom"), F.when(layout == "split", F.col("cam_region")).alias("cam"),
        first["track"].alias("track"),
    )


def speaker_segments(tracked: DataFrame, planned: DataFrame, shots: DataFrame) -> DataFrame:
    """The turns of the shots that follow the speaker: clip, shot, turn, track, start, end."""
    talk = planned.filter("layout = 'speaker'").select("clip", "shot", "start", "end")
    key = F.struct("clip", "shot")
    inside = in_shots(tracked, talk.withColumn("samples", F.lit(0))).filter("mouth is not null")
    present = presence(in_shots(tracked, shots)).filter("activity is not null").select("clip", "shot", "track")
    heard = inside.join(present, ["clip", "shot", "track"], "left_semi")
    mouths = heard.select(key.alias("clip"), F.col("track").alias("person"), (F.col("t") - F.col("start")).alias("t"), "mouth")
    lengths = talk.select(key.alias("clip"), (F.col("end") - F.col("start")).alias("duration_s"))
    turns = series.speaker_turns(mouths, lengths).select("clip.clip", "clip.shot", "turn", F.col("person").alias("track"), "start_s", "end_s")
    return turns.join(talk, ["clip", "shot"]).select(
        "clip", "shot", "turn", "track", (F.col("start") + F.col("start_s")).alias("start"), (F.col("start") + F.col("end_s")).alias("end")
    )


def keyframes(tracked: DataFrame, segments: DataFrame, width: int, height: int) -> DataFrame:
    """Where the crop's left edge is over time: clip, segment, t, x.

    ``segments``: clip, segment, track, start, end. Locked (a wide face, hardly any way, or under three readings): one key
    frame at the start, at the mean. Else the smoothed way of the face, held to both ends of the segment.
    """
    cw, _ = crop_size(F.lit(width), F.lit(height), 9, 16)
    spans = segments.select("clip", F.col("segment").alias("shot"), F.col("track").alias("_track"), "start", "end", F.lit(0).alias("samples"))
    mine = in_shots(tracked, spans).filter("track = _track")
    x = clamp(F.col("x") + F.col("w") / 2 - cw / 2, F.lit(0.0), F.lit(float(width)) - cw)
    raw = mine.select("clip", F.col("shot").alias("segment"), "start", "end", "t", "w", x.alias("v"))
    facts = raw.groupBy("clip", "segment", "start", "end").agg(
        F.count("*").alias("n"), F.avg("w").alias("w"), F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("way")
    )
    lock = (F.col("w") > cw * LOCK_WIDTH) | (F.col("way") < STILL_PX) | (F.col("n") < 3)
    still = facts.filter(lock).select("clip", "segment", F.col("start").alias("t"), F.col("mean").alias("x"))
    moving = raw.join(facts.filter(~lock).select("clip", "segment"), ["clip", "segment"], "left_semi")
    way = series.smoothed(moving.select("clip", "segment", "start", "end", "t", "v"), ["clip", "segment"])
    ends = way.groupBy("clip", "segment", "start", "end").agg(
        F.min_by("v", "t").alias("v0"), F.min("t").alias("t0"), F.max_by("v", "t").alias("v1"), F.max("t").alias("t1")
    )
    before = ends.filter("t0 > start").select("clip", "segment", F.col("start").alias("t"), F.col("v0").alias("x"))
    after = ends.filter("t1 < end").select("clip", "segment", F.col("end").alias("t"), F.col("v1").alias("x"))
    return still.unionByName(way.select("clip", "segment", "t", F.col("v").alias("x"))).unionByName(before).unionByName(after)


def tiled(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Segments (clip, start, end, layout, crop_x, locked) that cover a clip without gaps: clip, segment, start, end, layout, crop_x, locked.

    Specks of a hundredth of a second go; a locked crop within 12 px of the one before lengthens it; each ends where the next begins, the
    first starts at 0, the last ends with the clip. A fold over a clip's segments, which are as few as its shots.
    """
    row = F.struct("start", "end", "layout", F.col("crop_x").cast("double").alias("crop_x"), "locked")
    lists = segments.filter(F.col("end") - F.col("start") > 0.01).groupBy("clip").agg(F.array_sort(F.collect_list(row)).alias("_s"))

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        alike = last["locked"] & x["locked"] & (F.abs(last["crop_x"] - x["crop_x"]) < STILL_PX)
        longer = F.struct(*((x if c == "end" else last)[c].alias(c) for c in ("start", "end", "layout", "crop_x", "locked")))
        joined = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), longer)
        return F.when((F.size(out) > 0) & F.coalesce(alike, F.lit(False)), joined).otherwise(F.array_append(out, x))

    merged = lists.select("clip", F.aggregate("_s", F.slice("_s", F.lit(1), F.lit(0)), step).alias("_m")).join(lengths, "clip")
    each = merged.select("clip", "duration_s", "_m", F.posexplode("_m").alias("segment", "p"))
    after = F.get("_m", F.col("segment") + 1)["start"]
    return each.select(
        "clip", "segment", F.when(F.col("segment") == 0, 0.0).otherwise(F.col("p.start")).alias("start"), F.coalesce(after, "duration_s").alias("end"),
        "p.layout", "p.crop_x", "p.locked",
    )
