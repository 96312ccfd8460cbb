"""Joins over time: overlaps, as-of, nearest, complements.

Spans are half-open. Overlap joins put each span into the buckets it touches and join on (keys, bucket), so they
plan as hash or sort-merge joins and spread a hot key over its buckets; a pair is kept in the bucket where
its overlap begins, so none is seen twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import count_upto, let


def _in_buckets(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str],
    width: float, how: str = "inner", condition: Column | None = None,
) -> DataFrame:
    """Pairs whose spans overlap by more than 0. Apart from ``keys`` all column names differ.

    ``how`` is inner, left_semi or left_anti. For the latter two, the left side needs a column ``_row`` that
    identifies its rows.
    """
    a, b = _in_buckets(left, *l_span, width, "_bucket"), _in_buckets(right, *r_span, width, "_bucket")
    (ls, le), (rs, re) = l_span, r_span
    test = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    if condition is not None:
        test = test & condition
    if how == "inner":
        first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width)
        return a.join(b, [*keys, "_bucket"]).filter(test & (F.col("_bucket") == first)).drop("_bucket")
    hits = a.join(b, [*keys, "_bucket"]).filter(test).select("_row").distinct()
    return left.join(hits, "_row", how)


#: Seconds of a slice in which a running value is read by one window.
SLICE_S = 600.0


def running(
    rows: DataFrame, keys: list[str], t: str, order: list[Column], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
    before: bool = False, backward: bool = False, slice_s: float = SLICE_S,
) -> DataFrame:
    """``rows`` with the last value that is not null (``last``) and the running sums (``sums``) of each, by ``order`` within the keys.

    ``order`` begins with ``t``. ``before`` leaves a row's own value out; ``backward`` looks from the end (the next value that is not null). A scan of two levels:
    each slice of time is summed up (with partial aggregates), a window goes over the slices only, and one over
    the rows of each slice, so a key with all rows is dealt over as many tasks as it has slices. A null time is a slice of its own, the first.
    """
    last, sums = last or {}, sums or {}
    where = F.coalesce(F.floor(F.col(t) / slice_s), F.lit(-(1 << 62)))
    cut = rows.select("*", where.alias("_slice"), F.struct(*(o.alias(f"_{k}") for k, o in enumerate(order))).alias("_place"), *(c.alias(f"_v_{n}") for n, c in {**last, **sums}.items()))
    pick = F.min_by if backward else F.max_by
    ends = cut.groupBy(*keys, "_slice").agg(
        *(pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col("_place"))).alias(f"_c_{n}") for n in last),
        *(F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums),
    )
    by_slice = Window.partitionBy(*keys).orderBy(F.desc("_slice") if backward else F.asc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, "_slice", *(F.last(f"_c_{n}", ignorenulls=True).over(by_slice).alias(f"_c_{n}") for n in last), *(F.sum(f"_c_{n}").over(by_slice).alias(f"_c_{n}") for n in sums)
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_place") if backward else F.asc("_place")).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    both = with_row_of(cut, carry, [*keys, "_slice"])
    found = both.select(
        *rows.columns,
        *(F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")).alias(n) for n in last),
        *((F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums),
    )
    return found


def with_row_of(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the one row of ``right`` that has its keys, of which some may be null."""
    named = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(named, same, "left").drop(*(f"_k_{k}" for k in keys))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, at: str, value: str, slice_s: float = SLICE_S) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row with ``at`` <= ``t``; null before the first.

    Both sides as one relation, scanned on two levels (``running``); of equal times the largest value counts.
    """
    marks = right.select(*keys, F.col(at).alias(t), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = running(both, keys, t, [F.col(t), F.col("_side"), F.col("_v")], last={value: F.col("_v")}, slice_s=slice_s)
    return seen.filter("_side = 1").drop("_v", "_side")


def places(starts: Column, points: Column) -> Column:
    """``points`` (an array of structs with ``t``) with the place of the last of the rising ``starts`` at or before them, -1 before the first.

    ``as_of`` for a key whose marks lie in one row: binary searches, nothing is shuffled.
    """
    return let(starts, lambda s: F.transform(points, lambda p: p.withField("place", count_upto(s, p["t"]) - 1)))


def nearest(
    points: DataFrame, spans: DataFrame, keys: list[str], row: str, t: str, edge: str, radius: float, order: str
) -> DataFrame:
    """Each point with the span whose ``edge`` is nearest within ``radius``; ties go to the larger ``order``.

    ``row`` identifies the points; those without a span in reach are kept with nulls.
    """
    a = points.withColumn("_cell", F.explode(F.sequence(F.floor((F.col(t) - radius) / radius), F.floor((F.col(t) + radius) / radius))))
    b = spans.withColumn("_cell", F.floor(F.col(edge) / radius))
    found = (
        a.join(b, [*keys, "_cell"])
        .withColumn("_d", F.abs(F.col(edge) - F.col(t)))
        .filter(F.col("_d") <= radius)
        .groupBy(*keys, row)
        .agg(F.max_by(F.struct(*[c for c in spans.columns if c not in keys]), F.struct(-F.col("_d"), F.col(order))).alias("span"))
    )
    return points.join(found, [*keys, row], "left")


def islands(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], out: str = "island") -> DataFrame:
    """Numbers the groups of spans that hang together by overlaps, per key."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn(out, F.sum("_new").over(w)).drop("_new")


def complement(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The gaps between the spans of a key, from its first start to its last end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.select(*keys, upto.alias("gap_start"), F.col(start).alias("gap_end"))
        .filter("gap_start < gap_end")
    )


def shown_at(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, value: str) -> DataFrame:
    """``points`` with the ``value`` of the span that holds them: the last begun, if it has not ended; null between spans."""
    marks = spans.select(*keys, start, F.struct(F.col(value).alias("v"), F.col(end).alias("e")).alias("_span"))
    seen = as_of(points, marks, keys, t, start, "_span")
    return seen.withColumn(value, F.when(F.col(t) < F.col("_span.e"), F.col("_span.v"))).drop("_span")


def segment_at(points: DataFrame, segments: DataFrame, keys: list[str], t: str, start: str, value: str) -> DataFrame:
    """``points`` with the ``value`` of the last segment begun; before the first one, of the first."""
    first = segments.groupBy(*keys).agg(F.min_by(value, start).alias("_first"))
    return as_of(points, segments, keys, t, start, value).join(first, keys, "left").withColumn(value, F.coalesce(value, "_first")).drop("_first")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")
