"""Queries over event spans and energy curves: joins over time, silences, scoring and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp, millis
from quillspan.functions.spans import overlap_s, time_iou
from quillspan.operators import energy as loud
from quillspan.operators import intervals, selection
from quillspan.plans.transcripts import ms
from quillspan.sources import store
from quillspan.sources.adapters import ENERGY_SQL, FRAME_S, SPANS_SQL, energy, spans, table

_MS = "CAST(floor(({0}) * 1000 + 0.5) AS BIGINT)"
#: Buckets of the overlap joins, and spans of calm: three quiet events in a row.
BUCKET_S = 600.0
TARGET_S, SEARCH_S = 3.0, 0.75
SHORTLIST, PICKS = 24, 6


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    a = s.select(F.col("event_id").alias("a"), F.col("start_s").alias("a0"), F.col("end_s").alias("a1"))
    b = s.select(F.col("event_id").alias("b"), F.col("start_s").alias("b0"), F.col("end_s").alias("b1"))
    return intervals.overlap_join(a, b, [], ("a0", "a1"), ("b0", "b1"), BUCKET_S, condition=F.col("a") < F.col("b"))


def event_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("a", "b", millis(overlap_s(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))).alias("overlap_ms"))


def interval_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    iou = time_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    return p.select("a", "b", F.floor(iou * 1000 + 0.5).cast("long").alias("iou_1e3")).filter("iou_1e3 > 200")


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms(loud.silences(energy(spark, sf_dir), "user_id", FRAME_S), "start_s", "end_s")


def energy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loud.levels(energy(spark, sf_dir), "user_id")


def speech_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = energy(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("db") > -45).alias("loud"))
    return e.select("user_id", "frames", "loud", (F.col("loud") * 10 >= F.col("frames")).alias("has_speech"))


def plan_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = energy(spark, sf_dir)
    length = e.groupBy("user_id").agg((F.count("*") * FRAME_S).alias("duration_s"))
    return ms(loud.plan_cuts(loud.silences(e, "user_id", FRAME_S), length, "user_id", TARGET_S, SEARCH_S), "at_s")


def moment_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = energy(spark, sf_dir)
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    every = n.select("user_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 20).cast("int"))).alias("moment"))
    moments = every.select("user_id", "moment", (F.col("moment") * 2.0 + 0.05).alias("start_s"), (F.col("moment") * 2.0 + 2.95).alias("end_s"))
    found = loud.moment_energy(e, moments, "user_id", FRAME_S)
    return found.select("user_id", "moment", F.floor(F.col("energy") * 1000 + 0.5).cast("long").alias("energy_1e3"))


def nearest_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = energy(spark, sf_dir)
    quiet = loud.silences(e, "user_id", FRAME_S)
    probes = e.filter("db > -40").select("user_id", "frame", (F.col("frame") * FRAME_S + 0.037).alias("t"))
    near = intervals.nearest(probes, quiet, ["user_id"], "frame", "t", "end_s", 0.75, "start_s")
    return near.select("user_id", "frame", millis(F.col("span.start_s")).alias("start_ms"), millis(F.col("span.end_s")).alias("end_ms"))


def silence_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = energy(spark, sf_dir)
    quiet = loud.silences(e, "user_id", FRAME_S)
    length = e.groupBy("user_id").agg((F.count("*") * FRAME_S).alias("d"))
    clips = length.select("user_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("d") / 2).cast("int"))).alias("clip")).select(
        "user_id", "clip", (F.col("clip") * 2.0).alias("a"), (F.col("clip") * 2.0 + 3.0).alias("b")
    )
    hit = intervals.overlap_join(clips, quiet, ["user_id"], ("a", "b"), ("start_s", "end_s"), 5.0)
    total = hit.groupBy("user_id", "clip").agg(F.sum(millis(overlap_s(F.col("a"), F.col("b"), F.col("start_s"), F.col("end_s")))).alias("silent_ms"))
    return clips.join(total, ["user_id", "clip"], "left").select("user_id", "clip", F.coalesce("silent_ms", F.lit(0)).alias("silent_ms"))


def non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of clicks that touch no purchase of the same user."""
    s = spans(spark, sf_dir)
    clicks = s.filter("kind = 'click'").select(F.col("event_id").alias("_row"), "user_id", "start_s", "end_s")
    bought = s.filter("kind = 'purchase'").select("user_id", F.col("start_s").alias("p0"), F.col("end_s").alias("p1"))
    free = intervals.overlap_join(clicks, bought, ["user_id"], ("start_s", "end_s"), ("p0", "p1"), BUCKET_S, "left_anti")
    return free.select(F.col("_row").alias("event_id"), "user_id")


def chunk_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span belongs to the hour in which its middle lies: an equality, no range join."""
    s = spans(spark, sf_dir)
    mid = (F.col("start_s") + F.col("end_s")) / 2
    return s.select("event_id", F.floor(mid / 3600).cast("long").alias("hour"))


def uncovered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = intervals.complement(spans(spark, sf_dir), ["user_id"], "start_s", "end_s")
    return gaps.select("user_id", millis(F.col("gap_start")).alias("gap_start_ms"), millis(F.col("gap_end")).alias("gap_end_ms"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user as candidates: ten times as long, so that they overlap; prior from the value."""
    s = spans(spark, sf_dir).withColumn("end_s", F.col("start_s") + F.col("score") * 60)
    prior = F.floor(F.col("score") * 10) % 1000 / 1000
    return intervals.islands(s.withColumn("prior", prior).withColumnRenamed("event_id", "id"), ["user_id"], "start_s", "end_s", ["id"])


def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = selection.merge_duplicates(_candidates(spark, sf_dir), ["user_id"])
    return m.select("user_id", "id", "proposals", F.floor(F.col("prior") * 10_000 + 0.5).cast("long").alias("prior_1e4"))


def merge_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``merge_duplicates``, with every island of more than three spans by rounds."""
    m = selection.merge_duplicates(_candidates(spark, sf_dir), ["user_id"], most=3, width_s=3600.0)
    return m.select("user_id", "id", "proposals", F.floor(F.col("prior") * 10_000 + 0.5).cast("long").alias("prior_1e4"))


def finalists_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``greedy_finalists``, by rounds."""
    kept = selection.without_overlaps(_candidates(spark, sf_dir).withColumn("score", F.col("prior")), ["user_id"], most=3, width_s=3600.0)
    return selection.shortlist(kept, ["user_id"], SHORTLIST).select("user_id", "id", "place")


def greedy_finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.without_overlaps(_candidates(spark, sf_dir).withColumn("score", F.col("prior")), ["user_id"])
    return selection.shortlist(kept, ["user_id"], SHORTLIST).select("user_id", "id", "place")


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.shortlist(spans(spark, sf_dir).withColumnRenamed("event_id", "id"), ["user_id"], SHORTLIST).select("user_id", "id", "place")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged, greedy finalists, as a pool for selection; of every third user only the four best, so filler is needed."""
    merged = selection.merge_duplicates(_candidates(spark, sf_dir), ["user_id"], also=("kind", "island")).withColumn("score", F.col("prior"))
    finalists = selection.shortlist(selection.without_overlaps(merged, ["user_id"], also=("kind", "proposals")), ["user_id"], SHORTLIST)
    pool = finalists.filter("user_id % 3 != 0 or place <= 4")
    return pool.select(
        "user_id", "id", "start_s", "end_s", F.col("score").alias("quality"), F.when(F.col("proposals") > 1, "triaged").otherwise("discovered").alias("tier"), "kind",
        F.array("kind", F.concat(F.lit("w"), (F.col("id") % 4).cast("string")), F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))).alias("words"),
        F.array(F.concat(F.lit("t"), (F.col("id") % 6).cast("string"))).alias("topics"),
    )


def ambiguous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = selection.ambiguous_pairs(_pool(spark, sf_dir), ["user_id"], PICKS)
    return p.select("user_id", "a", "b", F.floor(F.col("likeness") * 10_000 + 0.5).cast("long").alias("likeness_1e4"))


def top_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per user, duplicates merged, greedy finalists, pairs of one story found, then the best distinct and diverse moments, filled up."""
    pool = store.cut(_pool(spark, sf_dir))
    pairs = selection.ambiguous_pairs(pool, ["user_id"], PICKS)
    risks = pairs.select("user_id", "a", "b", ((F.col("a") + F.col("b")) % 10 / 10).alias("p"), F.lit(False).alias("flagged"))
    linked = store.cut(selection.with_links(pool, ["user_id"], risks))
    filler = pool.filter("id % 5 < 3").select(
        "user_id", (F.col("id") + 1_000_000_000).alias("id"), (F.col("start_s") + 40).alias("start_s"), (F.col("end_s") + 40).alias("end_s"),
        F.lit(0.3).alias("quality"), F.lit("fallback").alias("tier"), F.lit("other").alias("kind"), "words", "topics",
        F.expr(f"cast(array() as {selection.LINKS})").alias("links"),
    )
    picked = selection.exactly(linked, filler, ["user_id"], PICKS)
    return ms(picked.select("user_id", "rank", "id", "start_s", "end_s", "tier", F.floor(F.col("final") * 10_000 + 0.5).cast("long").alias("final_1e4")), "start_s", "end_s")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and sizes of documents as stages' signals; a stage did not run where its signal is null."""
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    dims = F.create_map(F.lit("hook"), F.col("n_chars") % 11 * 1.0, F.lit("payoff"), F.col("n_chars") % 7 * 1.0, F.lit("context"), F.col("n_chars") % 5 * 2.0)
    return d.select("doc_id", "n_chars").join(x, "doc_id", "left").select(
        "doc_id", (F.col("n_chars") % 100 / 100).alias("prior"),
        F.when(F.col("n_chars") % 3 > 0, F.col("quality") * 0.8).alias("keep"), F.when(F.col("n_chars") % 3 > 0, F.col("quality") * 0.6 + 0.1).alias("priority"),
        F.when(F.col("n_chars") % 4 > 1, F.col("n_chars") % 10 / 10).alias("overall"), dims.alias("dims"),
        (F.col("toxic") == 0).alias("contained"),
        F.when(F.col("n_chars") % 5 == 4, F.col("n_chars") % 9 / 9).alias("verdict"), (F.col("n_chars") % 2 == 0).alias("verdict_keep"),
        F.when(F.col("n_chars") % 2 == 1, F.col("n_chars") % 13 / 13).alias("energy"),
    )


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    score = selection.composite(c("prior"), c("keep"), c("priority"), c("overall"), c("dims"), c("contained"), c("verdict"), c("energy"))
    return _signals(spark, sf_dir).select("doc_id", F.floor(score * 1000 + 0.5).cast("long").alias("score_1e3"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = selection.tier(F.when(c("prior") == 0, "fallback").otherwise("ai"), F.when(c("verdict").isNotNull(), c("verdict_keep")), c("overall"), c("priority"))
    rows = _signals(spark, sf_dir).select(name.alias("tier"), F.floor(clamp(c("prior") + selection.tier_adjust(name), 0.0, 1.0) * 1000 + 0.5).cast("long").alias("p"))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.sum("p").alias("sum_1e3"))


_PAIRS = f"WITH {SPANS_SQL} SELECT x.event_id AS a, y.event_id AS b, "
_FROM_PAIRS = " FROM spans x JOIN spans y ON x.event_id < y.event_id AND x.start_s < y.end_s AND y.start_s < x.end_s"
_BOTH = "(least(x.end_s, y.end_s) - greatest(x.start_s, y.start_s))"
_LEVELS = f"""{ENERGY_SQL}, ranked AS (
  SELECT user_id, db, row_number() OVER (PARTITION BY user_id ORDER BY db) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM energy WHERE db > -99
), levels AS (
  SELECT user_id, max(db) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))) AS floor_db,
    max(db) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.5::DOUBLE) AS BIGINT))) AS median_db FROM ranked GROUP BY user_id
), lev AS (SELECT *, greatest(-60, least(floor_db + 10, median_db - 8)) AS threshold_db FROM levels)"""
_QUIET = f"""{_LEVELS}, q AS (
  SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM energy JOIN lev USING (user_id) WHERE db < threshold_db
), quiet AS (
  SELECT user_id, floor(a * 1000 + 0.5) / 1000 AS start_s, floor(b * 1000 + 0.5) / 1000 AS end_s FROM (
    SELECT user_id, min(frame) * {FRAME_S}::DOUBLE AS a, (max(frame) + 1) * {FRAME_S}::DOUBLE AS b FROM q GROUP BY user_id, run) WHERE b - a >= 0.25
), len AS (SELECT user_id, count(*) AS n, count(*) * {FRAME_S}::DOUBLE AS d FROM energy GROUP BY user_id)"""

_IOU = "(greatest(0, least({0}.e, {1}.e) - greatest({0}.s, {1}.s)) / (({0}.e - {0}.s) + ({1}.e - {1}.s) - greatest(0, least({0}.e, {1}.e) - greatest({0}.s, {1}.s))))"
_OVER = "(greatest(0, least({0}.e, {1}.e) - greatest({0}.s, {1}.s)) / least({0}.e - {0}.s, {1}.e - {1}.s))"
_MERGED = f"""{SPANS_SQL}, cand AS (
  SELECT user_id, event_id AS id, start_s AS s, start_s + score * 60 AS e, floor(score * 10) % 1000 / 1000 AS p, kind FROM spans
), ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, s, id) AS k FROM cand
), mg AS (
  SELECT user_id, k, [{{'id': id, 's': s, 'e': e, 'p': p, 'n': 1}}] AS kept FROM ord WHERE k = 1
  UNION ALL
  SELECT user_id, k, CASE WHEN hit IS NULL THEN list_append(kept, {{'id': o.id, 's': o.s, 'e': o.e, 'p': o.p, 'n': 1}})
    ELSE list_transform(kept, lambda x, i: CASE WHEN i = hit THEN {{'id': x.id, 's': x.s, 'e': x.e, 'p': least(1.0::DOUBLE, greatest(x.p, o.p) + least(0.09::DOUBLE, 0.03::DOUBLE * x.n)), 'n': x.n + 1}} ELSE x END) END
  FROM (SELECT m.user_id, o.k, kept, o, nullif(list_position(list_transform(kept, lambda x: {_IOU.format('x', 'o')} > 0.4::DOUBLE), true), 0) AS hit
    FROM mg m JOIN ord o ON o.user_id = m.user_id AND o.k = m.k + 1)
), merged AS (SELECT user_id, unnest(kept, recursive := true) FROM (SELECT * FROM mg QUALIFY k = max(k) OVER (PARTITION BY user_id)))"""


def _greedy(name: str, rows: str) -> str:
    """CTEs: ``name`` has the spans of ``rows`` (user_id, id, s, e, p) that no better kept one covers, with their place."""
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, s, id) AS k FROM {rows}
), {name}_g AS (
  SELECT user_id, k, [{{'id': id, 's': s, 'e': e, 'p': p}}] AS kept FROM {name}_o WHERE k = 1
  UNION ALL
  SELECT m.user_id, o.k, CASE WHEN len(list_filter(kept, lambda x: {_OVER.format('x', 'o')} > 0.15::DOUBLE)) > 0 THEN kept ELSE list_append(kept, {{'id': o.id, 's': o.s, 'e': o.e, 'p': o.p}}) END
  FROM {name}_g m JOIN {name}_o o ON o.user_id = m.user_id AND o.k = m.k + 1
), {name}_l AS (SELECT user_id, unnest(kept, recursive := true) FROM (SELECT * FROM {name}_g QUALIFY k = max(k) OVER (PARTITION BY user_id))
), {name} AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, s, id) AS place FROM {name}_l QUALIFY place <= {SHORTLIST})"""


_POOL = f"""{_MERGED}, {_greedy('fin', 'merged')}, pool AS (
  SELECT f.user_id, f.id, f.s, f.e, f.p AS q, CASE WHEN n > 1 THEN 'triaged' ELSE 'discovered' END AS tier, kind, [kind, 'w' || f.id % 4, 'v' || f.id % 3] AS words, f.id % 6 AS topic
  FROM fin f JOIN merged m ON m.user_id = f.user_id AND m.id = f.id JOIN cand c ON c.user_id = f.user_id AND c.id = f.id WHERE f.user_id % 3 <> 0 OR place <= 4
), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY q DESC, s, id) AS rk FROM pool QUALIFY rk <= {2 * PICKS}
), pairs AS (
  SELECT x.user_id, x.id AS a, y.id AS b, len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) AS likeness
  FROM rk x JOIN rk y ON x.user_id = y.user_id AND x.rk < y.rk AND {_OVER.format('x', 'y')} <= 0.15::DOUBLE
  WHERE likeness >= 0.12::DOUBLE AND likeness < 0.5 QUALIFY row_number() OVER (PARTITION BY x.user_id ORDER BY x.rk, y.rk) <= {selection.ASKED_PAIRS}
), risks AS (SELECT user_id, list({{'a': a, 'b': b, 'p': (a + b) % 10 / 10}}) AS risks FROM pairs GROUP BY user_id)"""
_ADJUST = "CASE {0}.tier WHEN 'triaged' THEN -0.05::DOUBLE WHEN 'discovered' THEN -0.1::DOUBLE ELSE -0.25::DOUBLE END"
_R4 = "floor(({0}) * 10000 + 0.5) / 10000"
_MOST = "coalesce(list_max(list_transform(chosen, lambda h: {0})), 0.0::DOUBLE)"
_RISK = "coalesce(list_max(list_transform(list_filter(risks, lambda r: (r.a = c.id AND r.b = h.id) OR (r.a = h.id AND r.b = c.id)), lambda r: r.p)), 0.0::DOUBLE)"
_LIKE = "greatest(len(list_intersect(c.words, h.words)) / len(list_distinct(list_concat(c.words, h.words))), CASE WHEN c.topic = h.topic THEN 1 ELSE 0 END)"
_GAP = "greatest(h.s - c.e, c.s - h.e, 0.0::DOUBLE)"
_POINTS = f"""c.q + {_ADJUST.format('c')} - ({_R4.format(_MOST.format(f'CASE WHEN {_RISK} >= 0.5 THEN 0.4::DOUBLE * greatest({_RISK}, 0.75::DOUBLE) ELSE 0.0::DOUBLE END'))}
  + {_R4.format(_MOST.format(f'0.2::DOUBLE * least(1.0::DOUBLE, {_LIKE} * 2)'))}
  + {_R4.format("least(len(list_filter(chosen, lambda h: h.kind = c.kind AND c.kind <> 'other')) * 0.03::DOUBLE, 0.09::DOUBLE)")}
  + {_R4.format(_MOST.format(f'CASE WHEN {_GAP} < 45 THEN 0.05::DOUBLE * (1 - {_GAP} / 45) ELSE 0.0::DOUBLE END'))})"""


def _chosen(name: str, rows: str) -> str:
    """CTEs: ``name`` has up to PICKS rows of ``rows`` a user, chosen one after the other."""
    one = "{'id': id, 's': s, 'e': e, 'q': q, 'tier': tier, 'kind': kind, 'words': words, 'topic': topic}"
    return f"""{name}_r AS MATERIALIZED (SELECT user_id, list({one} ORDER BY q DESC, s, id) AS rows_ FROM {rows} GROUP BY user_id
), {name}_s AS (
  SELECT user_id, 0 AS n, list_filter(rows_, lambda c: false) AS chosen, false AS stuck FROM {name}_r
  UNION ALL
  SELECT user_id, n + 1, CASE WHEN best IS NULL THEN chosen ELSE list_append(chosen, best.c) END, best IS NULL FROM (
    SELECT r.user_id, n, chosen, list_sort(list_transform(list_filter(rows_, lambda c: len(list_filter(chosen, lambda h: h.id = c.id OR {_OVER.format('c', 'h')} > 0.15::DOUBLE)) = 0),
      lambda c: {{'points': {_POINTS}, 'early': -c.s, 'q': c.q, 'first': -c.id, 'c': c}}), 'DESC')[1] AS best
    FROM {name}_s s JOIN {name}_r r ON r.user_id = s.user_id LEFT JOIN risks k ON k.user_id = s.user_id WHERE n < {PICKS} AND NOT stuck)
), {name} AS (SELECT user_id, unnest(chosen, recursive := true) FROM (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1))"""


_TOP = f"""{_POOL}, {_chosen('first_', 'pool')}, short AS (
  SELECT p.user_id FROM (SELECT DISTINCT user_id FROM pool) p LEFT JOIN first_ f USING (user_id) GROUP BY p.user_id HAVING count(f.id) < {PICKS}
), spare AS (
  SELECT p.user_id, p.id + 1000000000 AS id, p.s + 40 AS s, p.e + 40 AS e, 0.3::DOUBLE AS q, 'fallback' AS tier, 'other' AS kind, words, topic FROM pool p JOIN short USING (user_id)
  WHERE p.id % 5 < 3 AND NOT EXISTS (SELECT 1 FROM first_ f WHERE f.user_id = p.user_id AND f.s < p.e + 40 AND p.s + 40 < f.e)
), again AS (SELECT * FROM pool WHERE user_id IN (SELECT user_id FROM short) UNION ALL BY NAME SELECT * FROM spare
), {_chosen('second_', 'again')}, picks AS (
  SELECT * FROM first_ WHERE user_id NOT IN (SELECT user_id FROM short) UNION ALL BY NAME SELECT * FROM second_
), fin_p AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, q + {_ADJUST.format('picks')})) AS final FROM picks)"""

QUERIES = {
    "event_overlap_pairs": (event_overlap_pairs, f"{_PAIRS}{_MS.format(_BOTH)} AS overlap_ms{_FROM_PAIRS}"),
    "interval_iou_pairs": (
        interval_iou_pairs,
        f"""SELECT * FROM ({_PAIRS}CAST(floor({_BOTH} / ((x.end_s - x.start_s) + (y.end_s - y.start_s) - {_BOTH}) * 1000 + 0.5) AS BIGINT)
        AS iou_1e3{_FROM_PAIRS}) WHERE iou_1e3 > 200""",
    ),
    "silences": (silences, f"WITH {_QUIET} SELECT user_id, {_MS.format('start_s')} AS start_ms, {_MS.format('end_s')} AS end_ms FROM quiet"),
    "energy_median": (energy_levels, f"WITH {_LEVELS} SELECT * FROM lev"),
    "speech_presence": (
        speech_presence,
        f"""WITH {ENERGY_SQL} SELECT user_id, count(*) AS frames, count(*) FILTER (WHERE db > -45) AS loud,
          count(*) FILTER (WHERE db > -45) * 10 >= count(*) AS has_speech FROM energy GROUP BY user_id""",
    ),
    "plan_cuts": (
        plan_cuts,
        f"""WITH RECURSIVE {_QUIET}, ps AS MATERIALIZED (
          SELECT user_id, d, coalesce(list({{'s': start_s, 'm': (start_s + end_s) / 2, 'l': end_s - start_s}}), []) AS ps
          FROM len LEFT JOIN quiet USING (user_id) GROUP BY user_id, d
        ), cuts AS (
          SELECT user_id, -1 AS cut, 0.0::DOUBLE AS last FROM ps
          UNION ALL
          SELECT user_id, cut + 1, coalesce(list_sort(list_transform(list_filter(ps, lambda p: p.m >= last + {TARGET_S} - {SEARCH_S}
              AND p.m <= last + {TARGET_S} + {SEARCH_S} AND p.m > last + {TARGET_S}::DOUBLE * 0.4::DOUBLE), lambda p: {{'l': -p.l, 's': p.s, 'm': p.m}}))[1].m, last + {TARGET_S})
          FROM cuts JOIN ps USING (user_id) WHERE d - last > {TARGET_S} * 1.25
        ) SELECT user_id, cut, {_MS.format('floor(last * 1000 + 0.5) / 1000')} AS at_ms FROM cuts WHERE cut >= 0""",
    ),
    "moment_energy": (
        moment_energy,
        f"""WITH {_QUIET}, moments AS (
          SELECT user_id, moment, moment * 2.0::DOUBLE + 0.05::DOUBLE AS s, moment * 2.0::DOUBLE + 2.95::DOUBLE AS e FROM len, unnest(range(0, n // 20 + 1)) AS t(moment)
        ), fr AS (
          SELECT m.user_id, moment, db, count(*) OVER w AS frames, count(*) FILTER (WHERE db > -99) OVER w AS n,
            row_number() OVER (PARTITION BY m.user_id, moment ORDER BY db DESC) AS r
          FROM moments m JOIN energy x ON x.user_id = m.user_id AND frame >= floor(s / {FRAME_S}::DOUBLE) AND frame < ceil(e / {FRAME_S}::DOUBLE)
          WINDOW w AS (PARTITION BY m.user_id, moment)
        ), lo AS (SELECT user_id, moment, avg(db) AS loud FROM fr WHERE r <= greatest(1, n // 10) AND db > -99 AND frames >= 10 GROUP BY ALL)
        SELECT user_id, moment, CASE WHEN loud IS NULL THEN 0 ELSE CAST(floor(greatest(0, least(1, (loud - coalesce(median_db, -60) - 6) / 12)) * 1000 + 0.5) AS BIGINT) END AS energy_1e3
        FROM moments LEFT JOIN lo USING (user_id, moment) LEFT JOIN lev USING (user_id)""",
    ),
    "nearest_silence": (
        nearest_silence,
        f"""WITH {_QUIET}, probes AS (SELECT user_id, frame, frame * {FRAME_S}::DOUBLE + 0.037::DOUBLE AS t FROM energy WHERE db > -40),
        near AS (SELECT p.user_id, frame, start_s, end_s, row_number() OVER (PARTITION BY p.user_id, frame ORDER BY abs(end_s - t), start_s DESC) AS r
          FROM probes p JOIN quiet q ON p.user_id = q.user_id AND abs(end_s - t) <= 0.75)
        SELECT user_id, frame, {_MS.format('start_s')} AS start_ms, {_MS.format('end_s')} AS end_ms
        FROM probes LEFT JOIN (SELECT * FROM near WHERE r = 1) USING (user_id, frame)""",
    ),
    "silence_inside": (
        silence_inside,
        f"""WITH {_QUIET}, clips AS (
          SELECT user_id, clip, clip * 2.0::DOUBLE AS a, clip * 2.0::DOUBLE + 3 AS b FROM len, unnest(range(0, CAST(floor(d / 2) AS BIGINT) + 1)) AS t(clip))
        SELECT c.user_id, clip, CAST(coalesce(sum(CASE WHEN start_s IS NOT NULL THEN {_MS.format('least(b, end_s) - greatest(a, start_s)')} END), 0) AS BIGINT) AS silent_ms
        FROM clips c LEFT JOIN quiet q ON q.user_id = c.user_id AND a < end_s AND start_s < b GROUP BY c.user_id, clip""",
    ),
    "non_overlapping": (
        non_overlapping,
        f"""WITH {SPANS_SQL} SELECT event_id, user_id FROM spans c WHERE kind = 'click' AND NOT EXISTS (
          SELECT 1 FROM spans p WHERE p.kind = 'purchase' AND p.user_id = c.user_id AND p.start_s < c.end_s AND c.start_s < p.end_s)""",
    ),
    "chunk_ownership": (
        chunk_ownership,
        f"WITH {SPANS_SQL} SELECT event_id, CAST(floor((start_s + end_s) / 2 / 3600) AS BIGINT) AS hour FROM spans",
    ),
    "uncovered_spans": (
        uncovered_spans,
        f"""WITH {SPANS_SQL}, u AS (SELECT user_id, start_s, max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM spans)
        SELECT user_id, {_MS.format('upto')} AS gap_start_ms, {_MS.format('start_s')} AS gap_end_ms FROM u WHERE upto < start_s""",
    ),
    "merge_duplicates": (
        merge_duplicates,
        f"WITH RECURSIVE {_MERGED} SELECT user_id, id, n AS proposals, CAST(floor(p * 10000 + 0.5) AS BIGINT) AS prior_1e4 FROM merged",
    ),
    "greedy_finalists": (greedy_finalists, f"WITH RECURSIVE {_MERGED}, {_greedy('fin', 'cand')} SELECT user_id, id, place FROM fin"),
    "merge_in_rounds": (
        merge_in_rounds,
        f"WITH RECURSIVE {_MERGED} SELECT user_id, id, n AS proposals, CAST(floor(p * 10000 + 0.5) AS BIGINT) AS prior_1e4 FROM merged",
    ),
    "finalists_in_rounds": (finalists_in_rounds, f"WITH RECURSIVE {_MERGED}, {_greedy('fin', 'cand')} SELECT user_id, id, place FROM fin"),
    "ambiguous_pairs": (
        ambiguous_pairs,
        f"WITH RECURSIVE {_POOL} SELECT user_id, a, b, CAST(floor(likeness * 10000 + 0.5) AS BIGINT) AS likeness_1e4 FROM pairs",
    ),
    "top_moments": (
        top_moments,
        f"""WITH RECURSIVE {_TOP} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY final DESC, s, id) AS rank, id, tier,
          CAST(floor(final * 10000 + 0.5) AS BIGINT) AS final_1e4, {_MS.format('s')} AS start_ms, {_MS.format('e')} AS end_ms FROM fin_p""",
    ),
    "shortlist": (
        shortlist,
        f"""WITH {SPANS_SQL} SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, start_s, event_id) AS place
        FROM spans QUALIFY place <= {SHORTLIST}""",
    ),
    "composite_scores": (
        composite_scores,
        """WITH s AS (
          SELECT doc_id, n_chars % 100 / 100 AS prior, CASE WHEN n_chars % 3 > 0 THEN quality * 0.8::DOUBLE END AS keep,
            CASE WHEN n_chars % 3 > 0 THEN quality * 0.6::DOUBLE + 0.1::DOUBLE END AS priority, CASE WHEN n_chars % 4 > 1 THEN n_chars % 10 / 10 END AS overall,
            (n_chars % 11 * 0.17::DOUBLE + n_chars % 7 * 0.15::DOUBLE + n_chars % 5 * 2.0 * 0.09::DOUBLE) / (0.17::DOUBLE + 0.15::DOUBLE + 0.09::DOUBLE) / 10 AS dim,
            toxic = 0 AS contained, CASE WHEN n_chars % 5 = 4 THEN n_chars % 9 / 9 END AS verdict, CASE WHEN n_chars % 2 = 1 THEN n_chars % 13 / 13 END AS energy
          FROM documents LEFT JOIN labels USING (doc_id)
        ), t AS (SELECT *, CASE WHEN priority IS NULL THEN prior ELSE 0.5::DOUBLE * priority + 0.3::DOUBLE * keep + 0.2::DOUBLE * prior END AS tri FROM s
        ), m AS (SELECT *, CASE WHEN overall IS NULL THEN tri ELSE 0.85::DOUBLE * (0.6::DOUBLE * overall + 0.4::DOUBLE * dim
            - CASE WHEN contained = false THEN 0.08::DOUBLE ELSE 0 END) + 0.15::DOUBLE * tri END AS sc FROM t
        ), v AS (SELECT *, CASE WHEN verdict IS NULL THEN sc ELSE 0.65::DOUBLE * verdict + 0.35::DOUBLE * sc END AS j FROM m)
        SELECT doc_id, CAST(floor(greatest(0, least(1, j + coalesce(0.06::DOUBLE * energy, 0))) * 1000 + 0.5) AS BIGINT) AS score_1e3 FROM v""",
    ),
    "tiers": (
        tiers,
        """WITH s AS (
          SELECT n_chars % 100 / 100 AS prior, CASE WHEN n_chars % 100 = 0 THEN 'fallback' WHEN n_chars % 5 = 4 AND n_chars % 2 = 0 THEN 'judged_keep'
            WHEN n_chars % 5 = 4 THEN 'judged_reject' WHEN n_chars % 4 > 1 THEN 'scored' WHEN n_chars % 3 > 0 AND quality IS NOT NULL THEN 'triaged' ELSE 'discovered' END AS tier
          FROM documents LEFT JOIN labels USING (doc_id))
        SELECT tier, count(*) AS n, CAST(sum(CAST(floor(greatest(0, least(1, prior + CASE tier WHEN 'fallback' THEN -0.25::DOUBLE WHEN 'judged_keep' THEN 0.12::DOUBLE
          WHEN 'judged_reject' THEN -0.3::DOUBLE WHEN 'triaged' THEN -0.05::DOUBLE WHEN 'discovered' THEN -0.1::DOUBLE ELSE 0 END)) * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS sum_1e3
        FROM s GROUP BY tier""",
    ),
}
