"""Overlaps of time spans (half-open) and of word ranges (inclusive), and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the inclusive ranges a..b and c..d."""
    both = F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c) + 1)
    return F.when(both == 0, 0.0).otherwise(both / ((b - a + 1) + (d - c + 1) - both))


def overlap_s(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def overlap_of_shorter(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap as a share of the shorter span; 0 if that has no length."""
    shorter = F.least(b - a, d - c)
    return F.when(shorter > 0, overlap_s(a, b, c, d) / shorter).otherwise(0.0)


def time_iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    both = overlap_s(a, b, c, d)
    return F.when(both == 0, 0.0).otherwise(both / ((b - a) + (d - c) - both))


def box_iou(a: Column, b: Column) -> Column:
    """Of two struct columns with x, y, w, h."""
    w = overlap_s(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"])
    h = overlap_s(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    return F.when(w * h == 0, 0.0).otherwise(w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h))


def mean_difference(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Mean absolute difference of two arrays of numbers."""
    each = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each) / scale


def crop_size(width: Column, height: Column, aspect_w: int, aspect_h: int) -> tuple[Column, Column]:
    """The largest crop of an aspect in a frame; the cut side is made even."""
    rounded = lambda x: F.floor(x + 0.5)
    even = lambda x: (F.floor(x / 2) * 2).cast("int")
    wide = rounded(height * aspect_w / aspect_h)
    fits = wide <= width
    return even(F.when(fits, wide).otherwise(width)), even(
        F.when(fits, height).otherwise(rounded(width * aspect_h / aspect_w))
    )
