"""Scoring and greedy selection of candidate spans.

Greedy steps only look at overlapping spans, so duplicates are merged per (key, island of overlaps): a hot key
is split wherever its spans leave a gap. Folds run inside the row, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp, let
from quillspan.functions.spans import overlap_of_shorter, time_iou
from quillspan.functions.text import jaccard
from quillspan.operators import dominance
from quillspan.sources import store

# Fixed values of the scoring rules.
WEIGHTS = {
    "hook": 0.17, "payoff": 0.15, "retention": 0.12, "context": 0.09, "completeness": 0.09, "opening": 0.07, "ending": 0.07,
    "curiosity": 0.05, "emotion": 0.05, "quotability": 0.05, "surprise": 0.04, "storytelling": 0.03, "usefulness": 0.02,
}
TIER_ADJUST = {"judged_keep": 0.12, "judged_reject": -0.3, "fallback": -0.25, "discovered": -0.1, "triaged": -0.05, "scored": 0.0}
MAX_OVERLAP, DUPLICATE_IOU = 0.15, 0.4
AGREEMENT, AGREEMENT_CAP = 0.03, 0.09
TOPIC, SAME_TYPE, SAME_TYPE_CAP, CROWDING, CROWDING_S, ENERGY = 0.2, 0.03, 0.09, 0.05, 45.0, 0.06
SAME_STORY, SAME_STORY_RISK, SURE = 0.4, 0.5, 0.75
#: Likeness between which a pair is asked about, and pairs asked about at once.
LIKE_LOW, LIKE_HIGH, ASKED_PAIRS = 0.12, 0.5, 24
LINKS = "array<struct<id: bigint, p: double, flagged: boolean>>"


def dimension_score(dims: Column) -> Column:
    """Weighted mean of the dimensions (0 to 10) that a map has, as 0 to 1; null without any."""
    have = [(F.coalesce(dims[k], F.lit(0.0)) * w, F.when(dims[k].isNotNull(), w).otherwise(0.0)) for k, w in WEIGHTS.items()]
    total, weight = F.lit(0.0), F.lit(0.0)
    for v, w in have:
        total, weight = total + v, weight + w
    return F.when(weight > 0, total / weight / 10)


def composite(
    prior: Column, keep: Column, priority: Column, overall: Column, dims: Column, contained: Column, verdict: Column, energy: Column
) -> Column:
    """All signals as one quality; later stages count more, and a null means that a stage did not run."""
    triaged = F.when(priority.isNotNull(), 0.5 * priority + 0.3 * keep + 0.2 * prior).otherwise(prior)
    mid = 0.6 * overall + 0.4 * F.coalesce(dimension_score(dims), triaged) - F.when(contained == F.lit(False), 0.08).otherwise(0.0)
    scored = F.when(overall.isNotNull(), 0.85 * mid + 0.15 * triaged).otherwise(triaged)
    judged = F.when(verdict.isNotNull(), 0.65 * verdict + 0.35 * scored).otherwise(scored)
    return clamp(judged + F.coalesce(ENERGY * energy, F.lit(0.0)), 0.0, 1.0)


def tier(source: Column, verdict_keep: Column, overall: Column, priority: Column) -> Column:
    return (
        F.when(source == "fallback", "fallback").when(verdict_keep, "judged_keep").when(~verdict_keep, "judged_reject")
        .when(overall.isNotNull(), "scored").when(priority.isNotNull(), "triaged").otherwise("discovered")
    )


def tier_adjust(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in TIER_ADJUST.items() for x in kv))[name]


def _by_size(spans: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Spans of islands of up to ``most`` spans, and of larger ones, written once."""
    spans = store.cut(spans)
    large = spans.groupBy(*keys, "island").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys, "island")
    return spans.join(large, [*keys, "island"], "left_anti"), spans.join(large, [*keys, "island"], "left_semi")


def _merged_in_rounds(spans: DataFrame, keys: list[str], width_s: float) -> DataFrame:
    ranked = spans.select(*keys, "id", "start_s", "end_s", "prior", F.struct((-F.col("prior")).alias("order"), "start_s", "id").alias("rank"))
    same = lambda a, b, c, d: time_iou(a, b, c, d) > DUPLICATE_IOU
    pairs = store.cut(dominance.conflicts(ranked, keys, same, width_s))
    gone = dominance.dropped(pairs, keys)
    absorbed = dominance.first_kept(pairs, gone, keys).groupBy(*keys, F.col("by").alias("id")).agg(F.count("*").alias("_more"))
    kept = ranked.join(gone, [*keys, "id"], "left_anti").join(absorbed, [*keys, "id"], "left")
    more = F.coalesce("_more", F.lit(0))
    # What is absorbed is never stronger, so only the bonuses count; after forty of them the prior is 1.
    steps = F.when(more > 0, F.sequence(F.lit(1), F.least(more.cast("int"), F.lit(40)))).otherwise(F.expr("cast(array() as array<int>)"))
    prior = F.aggregate(steps, F.col("prior"), lambda p, n: F.least(F.lit(1.0), p + F.least(F.lit(AGREEMENT_CAP), AGREEMENT * n)))
    return kept.select(*keys, "id", "start_s", "end_s", prior.alias("prior"), (more + 1).cast("int").alias("proposals"))


def merge_duplicates(spans: DataFrame, keys: list[str], most: int | None = None, width_s: float = 600.0, also: tuple[str, ...] = ()) -> DataFrame:
    """Collapses spans with an IoU above 0.4, strongest first; agreement raises the prior step by step.

    ``spans``: keys, island, id, start_s, end_s, prior. Returns keys, id, start_s, end_s, prior, proposals. Islands are folded in one row each;
    those of over ``most`` spans, if given, go by rounds (``dominance``), in buckets of ``width_s`` seconds. ``also``: further columns
    of the span that stays, which come with it, so that nothing has to be joined to it.
    """
    if most is not None:
        small, large = _by_size(spans, keys, most)
        rounds = _merged_in_rounds(large, keys, width_s)
        rounds = rounds.join(large.select(*keys, "id", *also), [*keys, "id"]) if also else rounds
        return merge_duplicates(small, keys, also=also).unionByName(rounds)
    row = F.struct((-F.col("prior")).alias("order"), "start_s", "id", "end_s", "prior", F.lit(1).alias("proposals"), *also)
    groups = spans.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.slice("rows", F.lit(1), F.lit(0))

    def step(kept: Column, c: Column) -> Column:
        same = lambda k: time_iou(k["start_s"], k["end_s"], c["start_s"], c["end_s"]) > DUPLICATE_IOU
        n = lambda k: k["proposals"] + c["proposals"]
        bonus = lambda k: F.least(F.lit(AGREEMENT_CAP), AGREEMENT * (n(k) - 1))
        merged = lambda first: F.transform(
            kept,
            lambda k: F.when(
                k["id"] == first,
                F.struct(
                    k["order"].alias("order"), k["start_s"].alias("start_s"), k["id"].alias("id"), k["end_s"].alias("end_s"),
                    F.least(F.lit(1.0), F.greatest(k["prior"], c["prior"]) + bonus(k)).alias("prior"), n(k).alias("proposals"),
                    *(k[x].alias(x) for x in also),
                ),
            ).otherwise(k),
        )
        merge = lambda first: F.when(first.isNull(), F.array_append(kept, c)).otherwise(merged(first))
        return let(F.get(F.filter(kept, same), F.lit(0))["id"], merge)

    kept = groups.select(*keys, F.explode(F.aggregate("rows", none, step)).alias("k"))
    return kept.select(*keys, "k.id", "k.start_s", "k.end_s", "k.prior", "k.proposals", *(f"k.{x}" for x in also))


def without_overlaps(spans: DataFrame, keys: list[str], limit: float = MAX_OVERLAP, most: int | None = None, width_s: float = 600.0, also: tuple[str, ...] = ()) -> DataFrame:
    """Greedy by score (ties: start, id): a span goes if a kept one covers more than ``limit`` of the shorter.

    Islands of over ``most`` spans, if given, go by rounds, and ``also`` names further columns to return, as in ``merge_duplicates``.
    """
    if most is not None:
        small, large = _by_size(spans, keys, most)
        ranked = large.select(*keys, "id", "start_s", "end_s", "score", F.struct((-F.col("score")).alias("order"), "start_s", "id").alias("rank"))
        over = lambda a, b, c, d: overlap_of_shorter(a, b, c, d) > limit
        gone = dominance.dropped(store.cut(dominance.conflicts(ranked, keys, over, width_s)), keys)
        rounds = large.join(gone, [*keys, "id"], "left_anti").select(*keys, "id", "start_s", "end_s", "score", *also)
        return without_overlaps(small, keys, limit, also=also).unionByName(rounds)
    row = F.struct((-F.col("score")).alias("order"), "start_s", "id", "end_s", *also)
    groups = spans.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(kept: Column, c: Column) -> Column:
        hit = F.exists(kept, lambda k: overlap_of_shorter(k["start_s"], k["end_s"], c["start_s"], c["end_s"]) > limit)
        return F.when(hit, kept).otherwise(F.array_append(kept, c))

    kept = groups.select(*keys, F.explode(F.aggregate("rows", F.slice("rows", F.lit(1), F.lit(0)), step)).alias("k"))
    return kept.select(*keys, "k.id", "k.start_s", "k.end_s", (-F.col("k.order")).alias("score"), *(f"k.{x}" for x in also))


def shortlist(spans: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` best per key by (score, start, id); Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "start_s", "id")
    return spans.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def ambiguous_pairs(pool: DataFrame, keys: list[str], n: int, most: int = ASKED_PAIRS) -> DataFrame:
    """keys, a, b, likeness: pairs of the 2n best of a key that do not overlap and are neither clearly alike nor different.

    ``pool``: as for ``select``. Flagged pairs are known already. Of a key the first ``most`` in order of rank. At most 2n rows of a key
    meet, which Spark's rank limit picks before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("quality"), "start_s", "id")
    links = F.col("links") if "links" in pool.columns else F.lit(None).cast(LINKS)
    top = pool.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= 2 * n).withColumn("links", links)
    side = lambda x: top.select(*keys, *(F.col(c).alias(f"{x}_{c}") for c in ("id", "rk", "start_s", "end_s", "words", "links")))
    both = side("a").join(side("b"), keys).filter("a_rk < b_rk")
    flagged = F.exists("a_links", lambda k: k["flagged"] & (k["id"] == F.col("b_id"))) | F.exists("b_links", lambda k: k["flagged"] & (k["id"] == F.col("a_id")))
    like = jaccard(F.col("a_words"), F.col("b_words"))
    apart = overlap_of_shorter(F.col("a_start_s"), F.col("a_end_s"), F.col("b_start_s"), F.col("b_end_s")) <= MAX_OVERLAP
    open_pairs = both.withColumn("likeness", like).filter(apart & (F.col("likeness") >= LIKE_LOW) & (F.col("likeness") < LIKE_HIGH) & ~F.coalesce(flagged, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy("a_rk", "b_rk")
    return open_pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"), "likeness")


def with_links(pool: DataFrame, keys: list[str], risks: DataFrame) -> DataFrame:
    """``pool`` with ``links``: what is known of a row and others, from risks (keys, a, b, p, flagged) either way round."""
    one = lambda x, y: risks.select(*keys, F.col(x).alias("id"), F.struct(F.col(y).cast("bigint").alias("id"), F.col("p").cast("double").alias("p"), F.coalesce("flagged", F.lit(False)).alias("flagged")).alias("_l"))
    lists = one("a", "b").unionByName(one("b", "a")).groupBy(*keys, "id").agg(F.collect_list("_l").alias("links"))
    return pool.join(lists, [*keys, "id"], "left").withColumn("links", F.coalesce("links", F.expr(f"cast(array() as {LINKS})")))


def select(pool: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Up to ``n`` distinct, diverse spans per key from a shortlisted pool; ``exactly`` fills up.

    ``pool``: keys, id, start_s, end_s, quality, tier, kind, words and, if there, topics (words of the topic) and links (what is known of
    it and others: id, risk p, flagged). Of rows with one id the best counts. A span that a chosen one covers by more than 0.15 of the
    shorter is out; the same story as a chosen one, likeness of words or topics, equal kinds and nearness cost points. Of equal
    points the earlier wins. Ranked by quality with the tier's adjustment, without the penalties.
    """
    topics = F.col("topics") if "topics" in pool.columns else F.expr("cast(array() as array<string>)")
    links = F.col("links") if "links" in pool.columns else F.expr(f"cast(array() as {LINKS})")
    row = F.struct(
        (-F.col("quality")).alias("order"), "start_s", "id", "end_s", "quality", "tier", "kind", "words", topics.alias("topics"), links.alias("links")
    )
    first = Window.partitionBy(*keys, "id").orderBy(F.desc("quality"), "start_s")
    unique = pool.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1")
    groups = unique.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    r4 = lambda x: F.floor(x * 10_000 + 0.5) / 10_000

    def points(c: Column, chosen: Column) -> Column:
        most = lambda f: F.aggregate(chosen, F.lit(0.0), lambda s, p: F.greatest(s, f(p)))

        def story(p: Column) -> Column:
            known = F.filter(F.concat(F.filter(c["links"], lambda k: k["id"] == p["id"]), F.filter(p["links"], lambda k: k["id"] == c["id"])), lambda k: k["p"].isNotNull() | k["flagged"])
            risk = F.aggregate(known, F.lit(0.0), lambda s, k: F.greatest(s, F.coalesce(k["p"], F.lit(0.0))))
            same = F.exists(known, lambda k: k["flagged"]) | (risk >= SAME_STORY_RISK)
            return F.when(same, SAME_STORY * F.greatest(risk, F.lit(SURE))).otherwise(0.0)

        def like(p: Column) -> Column:
            alike = F.greatest(jaccard(c["words"], p["words"]), jaccard(c["topics"], p["topics"]))
            return TOPIC * F.least(F.lit(1.0), alike * 2)

        alike = F.size(F.filter(chosen, lambda p: (p["kind"] == c["kind"]) & (c["kind"] != "other"))) * SAME_TYPE

        def near(p: Column) -> Column:
            gap = F.greatest(p["start_s"] - c["end_s"], c["start_s"] - p["end_s"], F.lit(0.0))
            return F.when(gap < CROWDING_S, CROWDING * (1 - gap / CROWDING_S)).otherwise(0.0)

        cost = r4(most(story)) + r4(most(like)) + r4(F.least(alike, F.lit(SAME_TYPE_CAP))) + r4(most(near))
        return c["quality"] + tier_adjust(c["tier"]) - cost

    def step(chosen: Column, _: Column) -> Column:
        free = F.filter(
            "rows",
            lambda c: ~F.exists(
                chosen,
                lambda p: (p["id"] == c["id"]) | (overlap_of_shorter(c["start_s"], c["end_s"], p["start_s"], p["end_s"]) > MAX_OVERLAP),
            ),
        )
        best = F.array_max(
            F.transform(
                free, lambda c: F.struct(points(c, chosen).alias("points"), (-c["start_s"]).alias("early"), c["quality"], (-c["id"]).alias("first"), c["id"].alias("id"))
            )
        )
        add = lambda b: F.concat(chosen, F.slice(F.filter("rows", lambda c: c["id"] == b["id"]), F.lit(1), F.lit(1)))
        return let(best, lambda b: F.when(b.isNull(), chosen).otherwise(add(b)))

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.slice("rows", F.lit(1), F.lit(0)), step)
    each = groups.select(*keys, F.explode(picked).alias("p")).select(*keys, "p.*")
    final = clamp(F.col("quality") + tier_adjust(F.col("tier")), 0.0, 1.0)
    rows = each.withColumn("final", final)
    w = Window.partitionBy(*keys).orderBy(F.desc("final"), "start_s", "id")
    return rows.select(*keys, "id", "start_s", "end_s", "quality", "tier", "final", F.row_number().over(w).alias("rank"))


def exactly(pool: DataFrame, filler: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``n`` picks a key wherever there is room: keys with fewer from the pool choose again among pool and filler.

    ``filler``: columns as ``pool``; filler that overlaps a key's picks at all is no help and leaves before. Keys without a pool
    count as short. The first picks are written (``store.cut``), as they are read five times.
    """
    picks = store.cut(select(pool, keys, n))
    counts = picks.groupBy(*keys).agg(F.count("*").alias("_n"), F.collect_list(F.struct("start_s", "end_s")).alias("_taken"))
    full = counts.filter(F.col("_n") >= n).select(*keys)
    free = ~F.exists("_taken", lambda p: (p["start_s"] < F.col("end_s")) & (F.col("start_s") < p["end_s"]))
    spare = filler.join(full, keys, "left_anti").join(counts, keys, "left").filter(F.coalesce(free, F.lit(True))).select(*filler.columns)
    again = pool.join(full, keys, "left_anti").unionByName(spare, allowMissingColumns=True)
    return picks.join(full, keys, "left_semi").unionByName(select(again, keys, n))


def best_boxes(boxes: DataFrame, keys: list[str], limit: float = 0.5) -> DataFrame:
    """Per frame, boxes by score; one goes if a kept one covers more than ``limit`` of the smaller of both."""
    row = F.struct((-F.col("score")).alias("order"), "x", "y", "w", "h")
    groups = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def covers(k: Column, c: Column) -> Column:
        across = F.greatest(F.lit(0.0), F.least(k["x"] + k["w"], c["x"] + c["w"]) - F.greatest(k["x"], c["x"]))
        down = F.greatest(F.lit(0.0), F.least(k["y"] + k["h"], c["y"] + c["h"]) - F.greatest(k["y"], c["y"]))
        return across * down > limit * F.least(k["w"] * k["h"], c["w"] * c["h"])

    step = lambda kept, c: F.when(F.exists(kept, lambda k: covers(k, c)), kept).otherwise(F.array_append(kept, c))
    kept = groups.select(*keys, F.explode(F.aggregate("rows", F.slice("rows", F.lit(1), F.lit(0)), step)).alias("k"))
    return kept.select(*keys, "k.x", "k.y", "k.w", "k.h", (-F.col("k.order")).alias("score"))
