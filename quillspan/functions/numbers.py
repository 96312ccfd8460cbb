"""Number coercions and scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it in a lambda."""
    return F.transform(F.array(value), then)[0]


def count_upto(values: Column, t: Column, below: bool = False) -> Column:
    """How many of rising ``values`` are at most (with ``below``: less than) ``t``: a binary search over the powers of two up to their number."""
    powers = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))
    steps = F.slice(powers, F.lit(25) - F.floor(F.log2(F.greatest(F.lit(1), F.size(values)))).cast("int"), F.lit(25))

    def step(at: Column, size: Column) -> Column:
        value = F.get(values, at + size - 1)
        inside = (at + size <= F.size(values)) & F.coalesce(value < t if below else value <= t, F.lit(False))
        return F.when(inside, at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


#: Values of a block, within which a running value is copied for each of them.
BLOCK = 32


def running(values: Column, op: Callable[[Column, Column], Column], kind: str) -> Column:
    """The running values of an array by an associative ``op`` (a sum, the greatest), of the type ``kind``; linear in its length.

    Blocks are folded each by itself and then put after what the blocks before them come to, so no fold appends to a long array.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    add = lambda xs, x: F.array_append(xs, F.when(F.size(xs) > 0, op(last(xs), x)).otherwise(x))
    fold = lambda xs: F.aggregate(xs, none, lambda s, x: add(s, x.cast(kind)))

    def by_block(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(all_) - 1), F.lit(BLOCK))
        inside = F.transform(starts, lambda at: fold(F.slice(all_, at + 1, F.lit(BLOCK))))
        return let(F.filter(inside, lambda b: F.size(b) > 0), joined)

    def joined(blocks: Column) -> Column:
        before = fold(F.transform(blocks, last))
        moved = lambda b, c: F.when(c.isNull(), b).otherwise(F.transform(b, lambda x: op(c, x)))
        return let(before, lambda ends: F.flatten(F.transform(blocks, lambda b, k: let(F.get(ends, k - 1), lambda c: moved(b, c)))))

    return let(values, by_block)


def half_up(value: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    f = 10.0**digits
    return F.floor(value * f + 0.5) / f


def millis(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + 0.5).cast("long")


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(low), F.least(as_column(high), value))


def _number(value: Column) -> Column:
    """A string as a number; blank counts as 0, infinite or unreadable as null."""
    n = F.when(F.trim(value) == "", 0.0).otherwise(value.try_cast("double"))
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def unit(value: Column) -> Column:
    """To 0..1 from a scale of 1, 10 or 100; true is 1."""
    n = _number(value)
    x = F.when(n > 10, n / 100).when(n > 1, n / 10).otherwise(n)
    return F.when(F.lower(value) == "true", 1.0).when(F.lower(value) == "false", 0.0).otherwise(
        F.when(n.isNotNull(), clamp(x, 0.0, 1.0))
    )


def ten(value: Column) -> Column:
    """To 0..10 from a scale of 1, 10 or 100; booleans are null."""
    n = _number(value)
    x = F.when(n > 10, n / 10).when((n > 0) & (n <= 1) & (n != F.floor(n)), n * 10).otherwise(n)
    return F.when(F.lower(value).isin("true", "false"), None).otherwise(F.when(n.isNotNull(), clamp(x, 0.0, 10.0)))


def whole(value: Column) -> Column:
    """Towards zero; unreadable is null."""
    n = _number(value)
    return F.when(F.lower(value).isin("true", "false"), None).otherwise(
        F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")
    )


def text_of(value: Column, limit: int = 200) -> Column:
    """A value as trimmed text of at most ``limit`` characters; null is empty."""
    return F.substring(F.trim(F.coalesce(value.cast("string"), F.lit(""))), 1, limit)


def proposals_per_window(duration_s: Column) -> Column:
    """About one a minute, 4 to 8."""
    return clamp(F.floor(duration_s / 60 + 0.5) + 2, F.lit(4).cast("long"), F.lit(8).cast("long"))


def filler_score(density: Column, silence: Column, text: Column) -> Column:
    """A plain prior for filler windows, 0 to 0.45."""
    has = lambda p, v: F.when(text.rlike(p), v).otherwise(0.0)
    score = (
        F.lit(0.15) + 0.12 * F.least(F.lit(1.0), density / 3) + has(r"\?", 0.06) + has("!", 0.05) + has("[0-9]", 0.04)
        - 0.1 * F.least(F.lit(1.0), silence * 2)
    )
    return half_up(clamp(score, 0.0, 0.45), 4)
