"""Render plans: pieces tile their clip and carry every layer's value; zoom, progress and boxes by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import render


def test_pieces_tile_their_clip_and_carry_each_layer(spark):
    rng = random.Random(4)
    clips, layers = [], {"a": [], "b": []}
    for clip in range(20):
        s = rng.choice([0.0, 2.5])
        clips.append((clip, s, s + 10.0))
        for name in layers:
            t = -2.0
            while t < 14:
                e = t + rng.choice([0.0, 0.5, 1.0, 3.0])
                if rng.random() < 0.7:
                    layers[name].append((clip, t, e, f"{name}{len(layers[name])}"))
                t = e + rng.choice([0.0, 0.0, 0.5]) + (0.5 if e == t else 0.0)
    clips.append((99, 1.0, 2.0))  # without any layer
    frame = lambda rows, kind: spark.createDataFrame(rows, f"clip int, start_s double, end_s double{kind}")
    got = render.pieces(frame(clips, ""), {n: frame(r, ", value string") for n, r in layers.items()}, ["clip"]).collect()
    value = lambda name, clip, t: next((v for c, s, e, v in layers[name] if c == clip and s <= t < e), None)
    for clip, s, e in clips:
        own = sorted((r.piece, r.start_s, r.end_s, r.a, r.b) for r in got if r.clip == clip)
        assert [r[0] for r in own] == list(range(len(own)))
        assert own[0][1] == s and own[-1][2] == e and all(x[2] == y[1] for x, y in zip(own, own[1:], strict=False))
        for _, a, b, *values in own:
            for t in (a, (a + b) / 2):
                assert values == [value("a", clip, t), value("b", clip, t)]
        borders = {t for n in layers for c, x, y, _ in layers[n] if c == clip and y > x for t in (x, y) if s < t < e}
        assert {r[1] for r in own[1:]} == borders


def test_pieces_of_nothing(spark):
    none = spark.createDataFrame([], "clip int, start_s double, end_s double")
    assert render.pieces(none, {"a": none.withColumn("value", F.lit(1))}, ["clip"]).collect() == []


def test_layers_in_rows_are_cut_as_layers_in_tables(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(render, "SPANS", 40)
    rows, clips, layers = [], [], {"a": [], "b": []}
    for key in range(30):
        own = {"a": [], "b": []}
        for name, spans in own.items():
            t = -2.0
            while t < 14 and key % 7:
                e = t + rng.choice([0.0, 0.1, 0.5, 1.0, 3.0])
                if rng.random() < 0.7:
                    spans.append((t, e, f"{name}{len(spans)}"))
                t = e + rng.choice([0.0, 0.0, 0.5]) + (0.5 if e == t else 0.0)
        mine = [(c, c * 3.0, c * 3.0 + rng.choice([2.0, 3.0, 7.5])) for c in range(key % 4)]
        rows.append((f"k{key}", mine, own["a"], None if key == 5 else own["b"]))
        clips += [(f"k{key}", *c) for c in mine]
        for name in layers:
            layers[name] += [(f"k{key}", c[0], *x) for c in mine for x in own[name] if not (name == "b" and key == 5)]
    kind = "array<struct<start_s: double, end_s: double, value: string>>"
    table = spark.createDataFrame(rows, f"key string, clips array<struct<clip: int, start_s: double, end_s: double>>, a {kind}, b {kind}").coalesce(1)
    part = lambda n, f: F.transform(n, lambda x: x[f])
    got = render.pieces_of(table, ["key"], F.col("clips"), {n: render.layer(part(n, "start_s"), part(n, "end_s"), part(n, "value")) for n in layers})
    of = lambda rows, kind: spark.createDataFrame(rows, f"key string, clip int, start_s double, end_s double{kind}")
    want = render.pieces(of(clips, ""), {n: of(r, ", value string") for n, r in layers.items()}, ["key", "clip"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_long_clip_takes_time_in_proportion(spark):
    n = 60_000
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * 0.5)
    words = render.layer(at, F.transform(at, lambda t: t + 0.25), F.sequence(F.lit(0), F.lit(n - 1)))
    clips = F.array(F.struct(F.lit(0).alias("clip"), F.lit(0.0).alias("start_s"), F.lit(n * 0.5).alias("end_s")))
    got = render.pieces_of(spark.range(1), ["id"], clips, {"word": words}).agg(F.count(F.lit(1)), F.count("word"), F.sum(F.col("end_s") - F.col("start_s"))).first()
    assert tuple(got) == (2 * n, n, n * 0.5)


@pytest.mark.parametrize(("t", "frames", "length", "want"), [(0.0, 0, 10.0, 1.0), (5.0, 1, 10.0, 0.97), (20.0, None, 10.0, 0.94), (5.0, 2, 10.0, 1.0), (2.0, 0, 3.9, 1.0)])
def test_zoom_by_hand(spark, t, frames, length, want):
    scale = render.zoom(F.lit(t), F.lit(0.0), F.lit(length), F.lit(frames).cast("int"))
    rect = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(100.0).alias("w"), F.lit(200.0).alias("h"))
    s, r = spark.range(1).select(scale, render.zoomed(rect, scale)).first()
    assert s == pytest.approx(want) and (r.x, r.y, r.w, r.h) == pytest.approx((10 + (100 - 100 * s) / 2, 20 + (200 - 200 * s) * 0.4, 100 * s, 200 * s))


def test_progress_and_boxes_by_hand(spark):
    part = lambda t, a, b: spark.range(1).select(render.progress(F.lit(t), F.lit(a), F.lit(b))).first()[0]
    assert [part(0.5, 1.0, 2.0), part(1.25, 1.0, 2.0), part(3.0, 1.0, 2.0)] == [0.0, 0.25, 1.0]
    assert part(1.025, 1.0, 1.0) == pytest.approx(0.5)  # a word of no length lasts a twentieth of a second
    box = lambda *x: tuple(spark.range(1).select(render.caption_box(*map(F.lit, x))).first()[0])
    assert box(1080.0, 1920.0, 0.05, 1, 0.2, 0.1, 0.1) == pytest.approx((96, 1536 - 96 * 1.18, 1536))
    assert box(1080.0, 1920.0, 0.05, 1, 0.02, 0.1, 0.1)[2] == pytest.approx(1728)  # not into the lower border
    assert box(1080.0, 1920.0, 0.05, 2, 0.95, 0.1, 0.1)[1] == pytest.approx(192)  # nor the upper one
