"""Connected components on Spark: alternating large-star and small-star steps.

Defined results: pairs may be repeated, in either order; a pair of equal nodes and one with a null is no link; without
pairs there are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import forget, written

#: Nodes whose least neighbours may be broadcast (16 bytes each: 8 MB).
SMALL = 500_000


def _stars(pairs: DataFrame, small: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v, m): each pair with the least of u and all its v; and tables to forget.

    Few nodes are broadcast, so the pairs of a hub stay where they are; many are written first, as the join of two
    plain shuffles is one that AQE can split at a hub.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if small:
        return pairs.join(F.broadcast(least), "u"), []
    table = written(least)
    return pairs.join(table, "u"), [table]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the (a, b) pairs but the roots themselves; root is the least node reachable.

    A round ends in a table in the shared folder, and the one before is deleted; rounds repeat until nothing changes, about the
    logarithm of the longest chain. Nothing but a count and a checksum reaches the driver.
    """
    state, seen = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, few = mark, 2 * mark[0] <= SMALL
        stars, used = _stars(state.selectExpr("stack(2, u, v, v, u) as (u, v)"), few)
        # One row a pair at most, so repeats only count where the rows are shuffled again.
        large = stars.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars, more = _stars(large if few else large.distinct(), few)
        after = written(stars.selectExpr("stack(2, v, m, u, m) as (u, v)").filter("u != v").distinct())
        forget(state, *used, *more)
        state = after
