"""Clip boundaries: snapped to sentences, clamped to a length, aligned with silences; and filler windows.

All rules are expressions over the arrays of one transcript (``starts``, ``ends``, ``stops``), so many proposals of a
transcript are refined in one row without copying its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp, count_upto, filler_score, half_up, let
from quillspan.functions.text import ends_sentence

# Words to search for a sentence edge, seconds around silences.
REACH = 12
LEAD_S, TAIL_S, RADIUS_S = 0.25, 0.35, 0.75
SILENCE_LEAD_S, SILENCE_TAIL_S, MARGIN_S = 0.12, 0.28, 0.04


def _first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def _around(index: Column, sign: int) -> Column:
    """index, then one word off on the side of ``sign``, on the other, two words off, ..."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(REACH)), lambda o: F.array(index + sign * o, index - sign * o)))


def snap_start(index: Column, stops: Column) -> Column:
    """The first word of the nearest sentence, the earlier of two."""
    hit = _first(_around(index, -1), lambda c: (c <= 0) | ((c < F.size(stops)) & F.coalesce(F.get(stops, c - 1), F.lit(False))))
    return F.when(index <= 0, 0).otherwise(F.greatest(F.lit(0), F.coalesce(hit, index)))


def snap_end(index: Column, stops: Column) -> Column:
    """The last word of the nearest sentence, the later of two."""
    last = F.size(stops) - 1
    hit = _first(_around(index, 1), lambda c: (c >= last) | ((c >= 0) & F.coalesce(F.get(stops, c), F.lit(False))))
    return F.when(index >= last, last).otherwise(F.least(last, F.coalesce(hit, index)))


def _stops_between(stops: Column, a: Column, b: Column) -> Column:
    """Indices of sentence ends from a to b."""
    none = F.expr("cast(array() as array<int>)")
    return F.when(a <= b, F.filter(F.sequence(a, F.greatest(a, b)), lambda k: F.coalesce(F.get(stops, k), F.lit(False)))).otherwise(none)


def fit_end(start: Column, end: Column, starts: Column, ends: Column, stops: Column, least_s: float, most_s: float) -> Column:
    """The end word for which the clip is neither too long nor too short; null if there is none."""
    lasts = lambda e: F.get(ends, e) - F.get(starts, start)

    def with_limit(limit: Column) -> Column:  # the last word that still fits
        def shortened(e: Column) -> Column:
            at_stop = F.array_max(_stops_between(stops, start + 1, F.least(e, limit)))
            any_word = F.when(F.least(e, limit) > start, F.least(e, limit))
            return F.when(e > limit, F.coalesce(at_stop, any_word)).otherwise(e)

        def lengthened(e: Column) -> Column:
            later = _stops_between(stops, e + 1, limit)
            enough = _first(later, lambda k: lasts(k) >= least_s)
            return F.when(lasts(e) < least_s, F.coalesce(enough, F.array_max(later), e)).otherwise(e)

        return let(shortened(end), lambda e: let(lengthened(e), lambda x: F.when((lasts(x) >= least_s) & (lasts(x) <= most_s), x)))

    return let(count_upto(ends, F.get(starts, start) + most_s) - 1, with_limit)


def by_edges(silences: Column) -> Column:
    """Silences in order of their starts and of their ends, for searches by either edge: a struct (start_s, end_s) of (keys, spans), and whether both orders are the same."""

    def by(edge: str) -> Column:
        order = F.array_sort(F.transform(silences, lambda s, k: F.struct(s[edge].alias("at"), k.alias("k"), s["start_s"].alias("start_s"), s["end_s"].alias("end_s"))))
        return let(order, lambda o: F.struct(F.transform(o, lambda s: s["at"]).alias("keys"), o.alias("spans"))).alias(edge)

    def both(s: Column, e: Column) -> Column:
        places = lambda side: F.transform(side["spans"], lambda x: x["k"])
        return F.struct(s.alias("start_s"), e.alias("end_s"), (places(s) == places(e)).alias("same_order"))

    return let(F.struct(by("start_s"), by("end_s")), lambda q: both(q["start_s"], q["end_s"]))


def _nearest(silences: Column, edge: str, t: Column) -> Column:
    """The silence whose edge is nearest within reach; of equals the last in the list."""
    near = F.filter(silences, lambda s: F.abs(s[edge] - t) <= RADIUS_S)
    ranked = F.transform(near, lambda s, k: F.struct((-F.abs(s[edge] - t)).alias("near"), k.alias("k"), s["start_s"].alias("start_s"), s["end_s"].alias("end_s")))
    return F.array_max(ranked)


def _nearest_of(quiet: Column, edge: str, t: Column) -> Column:
    """As ``_nearest``, of silences ``by_edges``: the one whose edge is nearest within reach; of equals the last in the list.

    Only those around the place of ``t`` are looked at, so a transcript's boundaries take linear time in its silences.
    """
    keys, spans = quiet[edge]["keys"], quiet[edge]["spans"]
    # A hair more than the reach, as sums round; the filter decides.
    window = let(count_upto(keys, t - RADIUS_S - 0.001), lambda a: F.slice(spans, a + 1, F.greatest(F.lit(0), count_upto(keys, t + RADIUS_S + 0.001) - a)))
    near = F.filter(window, lambda s: F.abs(s[edge] - t) <= RADIUS_S)
    return F.array_max(F.transform(near, lambda s: F.struct((-F.abs(s[edge] - t)).alias("near"), s["k"].alias("k"), s["start_s"].alias("start_s"), s["end_s"].alias("end_s"))))


def align_start(t: Column, silences: Column, nearest=_nearest) -> Column:
    def with_silence(s: Column) -> Column:
        kept = F.greatest(F.least(s["start_s"] + MARGIN_S, s["end_s"]), F.least(s["end_s"] - SILENCE_LEAD_S, t))
        return F.greatest(F.lit(0.0), F.when(s.isNull(), t - LEAD_S).otherwise(kept))

    return let(nearest(silences, "end_s", t), with_silence)


def align_end(t: Column, silences: Column, nearest=_nearest) -> Column:
    def with_silence(s: Column) -> Column:
        kept = F.greatest(t, F.least(s["start_s"] + SILENCE_TAIL_S, F.greatest(s["end_s"] - MARGIN_S, s["start_s"])))
        return F.when(s.isNull(), t + TAIL_S).otherwise(kept)

    return let(nearest(silences, "start_s", t), with_silence)


def refine(first: Column, last: Column, starts: Column, ends: Column, stops: Column, silences: Column, least_s: float, most_s: float) -> Column:
    """A struct (first, last, start_s, end_s) for a proposed word range, or null where no fit is possible."""
    return let(by_edges(silences), lambda quiet: refined(first, last, starts, ends, stops, quiet, least_s, most_s))


def refined(first: Column, last: Column, starts: Column, ends: Column, stops: Column, quiet: Column, least_s: float, most_s: float) -> Column:
    """``refine`` with silences ``by_edges``, which are sorted once for all ranges of a transcript."""
    top = F.size(stops) - 1

    def snapped(p: Column) -> Column:
        e = fit_end(p["a"], p["b"], starts, ends, stops, least_s, most_s)
        return F.when(p["b"] > p["a"], let(e, lambda x: F.when(x.isNotNull(), placed(p["a"], x))))

    def placed(a: Column, b: Column) -> Column:
        s, e = align_start(F.get(starts, a), quiet, _nearest_of), align_end(F.get(ends, b), quiet, _nearest_of)
        return let(s, lambda s0: F.struct(a.alias("first"), b.alias("last"), s0.alias("start_s"), F.least(e, s0 + most_s).alias("end_s")))

    begin = clamp(first, F.lit(0), top)
    return let(F.struct(snap_start(begin, stops).alias("a"), snap_end(F.greatest(begin, F.least(last, top)), stops).alias("b")), snapped)


def transcripts(words: DataFrame) -> DataFrame:
    """doc_id and the arrays of its words: text, starts, ends, stops."""
    each = F.struct("idx", "text", "start_s", "end_s", ends_sentence(F.col("text")).alias("stop"))
    rows = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("w"))
    return rows.select("doc_id", F.col("w.text").alias("tokens"), F.col("w.start_s").alias("starts"), F.col("w.end_s").alias("ends"), F.col("w.stop").alias("stops"))


def bound(then) -> Column:
    """``then`` of a struct with the arrays starts, ends and stops of the row, each made once."""
    return let(F.struct("starts", "ends", "stops"), then)


def transcripts_of(lists: DataFrame) -> DataFrame:
    """``transcripts`` of rows that are whole: doc_id, tokens, starts, ends. Narrow."""
    return lists.select("doc_id", "tokens", "starts", "ends", F.transform("tokens", ends_sentence).alias("stops"))


def silence_in(silences: Column, a: Column, b: Column) -> Column:
    """Seconds of a span that are silent."""
    each = F.transform(silences, lambda s: F.greatest(F.lit(0.0), F.least(b, s["end_s"]) - F.greatest(a, s["start_s"])))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x)


def silence_of(quiet: Column, a: Column, b: Column) -> Column:
    """``silence_in`` of silences ``by_edges``: those that begin before the span's end and, if both orders are the same, end after its start."""
    starts = quiet["start_s"]
    begun = count_upto(starts["keys"], b)
    over = F.when(quiet["same_order"], count_upto(quiet["end_s"]["keys"], a)).otherwise(0)
    return let(F.struct(begun.alias("n"), over.alias("a")), lambda w: silence_in(F.slice(starts["spans"], w["a"] + 1, F.greatest(F.lit(0), w["n"] - w["a"])), a, b))


def filler_windows(rows: DataFrame, least_s: float, most_s: float) -> DataFrame:
    """Sentence-bounded windows one after the other, with a plain score: doc_id, win, first, last, start_s, end_s, score.

    ``rows``: ``transcripts`` and, if there, silences and avoid (picks whose time a window must not touch), arrays of (start_s, end_s).
    Every sentence start is refined by itself; a fold then takes those that begin after the last one taken.
    """
    target = min(most_s, max(least_s * 1.5, (least_s + most_s) / 3))
    none = F.expr("cast(array() as array<struct<start_s: double, end_s: double>>)")
    given = lambda name: (F.coalesce(name, none) if name in rows.columns else none).alias(name)
    rows = rows.select(*(c for c in rows.columns if c not in ("silences", "avoid")), given("silences"), given("avoid"))

    def windows(t: Column) -> Column:
        def window(k: Column) -> Column:
            guess = F.greatest(k + 1, count_upto(t["starts"], F.get(t["starts"], k) + target) - 1)
            at = lambda last: refined(k, last, t["starts"], t["ends"], t["stops"], t["quiet"], least_s, most_s)
            return let(let(guess, at), lambda c: F.struct(F.get(t["starts"], k).alias("open_s"), c.alias("clip")))

        opens = F.filter(F.sequence(F.lit(0), F.size(t["stops"]) - 1), lambda k: (k == 0) | F.coalesce(F.get(t["stops"], k - 1), F.lit(False)))
        return F.filter(F.transform(opens, window), lambda x: x["clip"].isNotNull())

    found = let(F.struct("starts", "ends", "stops", by_edges(F.col("silences")).alias("quiet")), windows)
    kept0 = F.struct(F.lit(-1.0).alias("upto"), F.slice("found", F.lit(1), F.lit(0)).alias("out"))

    def step(s: Column, c: Column) -> Column:
        clip = c["clip"]
        touched = F.exists("avoid", lambda p: (p["start_s"] < clip["end_s"]) & (clip["start_s"] < p["end_s"]))
        free = (c["open_s"] >= s["upto"]) & (clip["start_s"] >= s["upto"]) & ~touched
        return F.when(free, F.struct(clip["end_s"].alias("upto"), F.array_append(s["out"], c).alias("out"))).otherwise(s)

    taken = rows.withColumn("found", found).withColumn("taken", F.aggregate("found", kept0, step, lambda s: s["out"]))

    # Text and silence are looked up in the transcript's row, so that no window carries a copy of its arrays.
    def described(t: Column, c: Column) -> Column:
        clip = c["clip"]
        text = F.array_join(F.slice(t["tokens"], clip["first"] + 1, clip["last"] - clip["first"] + 1), " ")
        return F.struct(clip.alias("clip"), text.alias("text"), silence_of(t["quiet"], clip["start_s"], clip["end_s"]).alias("silent"))

    full = let(F.struct("tokens", by_edges(F.col("silences")).alias("quiet")), lambda t: F.transform("taken", lambda c: described(t, c)))
    # Outer, as a filter on the list's size would make it once more.
    each = taken.select("doc_id", F.posexplode_outer(full).alias("win", "c")).filter("win is not null").select("doc_id", "win", "c.clip.*", "c.text", "c.silent")
    length = F.greatest(F.lit(0.001), F.col("end_s") - F.col("start_s"))
    density = half_up((F.col("last") - F.col("first") + 1) / length, 3)
    return each.select("doc_id", "win", "first", "last", "start_s", "end_s", filler_score(density, half_up(F.col("silent") / length, 3), F.col("text")).alias("score"))


def normalised(transcripts: DataFrame, proposals: DataFrame, least_s: float, most_s: float) -> tuple[DataFrame, DataFrame]:
    """Proposals (doc_id, id, first, last, prior) with boundaries, and the counters (doc_id, proposed, no_boundary, refined).

    ``transcripts`` as for ``filler_windows``. A transcript and its proposals meet in one row.
    """
    none = F.expr("cast(array() as array<struct<start_s: double, end_s: double>>)")
    quiet = F.coalesce("silences", none) if "silences" in transcripts.columns else none
    lists = proposals.groupBy("doc_id").agg(F.collect_list(F.struct("id", "first", "last", "prior")).alias("proposals"))
    return normalised_rows(transcripts.withColumn("silences", quiet).join(lists, "doc_id"), least_s, most_s)


def normalised_rows(rows: DataFrame, least_s: float, most_s: float) -> tuple[DataFrame, DataFrame]:
    """``normalised`` of transcripts (one row a document) that have silences and their ``proposals``, an array of (id, first, last, prior). Narrow."""

    def offers(t: Column) -> Column:
        clip = lambda p: refined(p["first"], p["last"], t["starts"], t["ends"], t["stops"], t["quiet"], least_s, most_s)
        return F.transform("proposals", lambda p: F.struct(p.alias("p"), F.when(p["last"] > p["first"], clip(p)).alias("c")))

    found = rows.select("doc_id", let(F.struct("starts", "ends", "stops", by_edges(F.col("silences")).alias("quiet")), offers).alias("offers"))
    n = lambda test: F.aggregate(F.transform("offers", lambda o: test(o["c"]).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    report = found.select("doc_id", F.size("offers").cast("long").alias("proposed"), n(lambda c: c.isNull()).alias("no_boundary"), n(lambda c: c.isNotNull()).alias("refined"))
    # Outer, as a filter on the list's size would make it once more.
    good = found.select("doc_id", F.explode_outer("offers").alias("o")).filter("o.c is not null")
    return good.select("doc_id", F.col("o.p.id").alias("id"), F.col("o.p.prior").alias("prior"), "o.c.*"), report


def candidate_id(first: Column, last: Column) -> Column:
    return F.format_string("c%d_%d", first, last)


def trimmed(sentences: Column, first: Column, last: Column, move_first: Column, move_last: Column, starts: Column, ends: Column, silences: Column) -> Column:
    """A clip's sentences first..last with moved edges, kept in bounds and in order: a struct (first, last, start_s, end_s).

    ``sentences``: array of (first, last) words. Edges are aligned with silences again, without a limit of length; a move that would cross
    the other edge is not made.
    """
    top = F.size(sentences) - 1
    a, b = clamp(first + move_first, F.lit(0), top), clamp(last + move_last, F.lit(0), top)

    def placed(p: Column) -> Column:
        words = F.struct(F.get(sentences, p["a"])["first"].alias("x"), F.get(sentences, p["b"])["last"].alias("y"))
        return let(words, lambda w: F.struct(
            p["a"].alias("first"), p["b"].alias("last"), align_start(F.get(starts, w["x"]), silences).alias("start_s"), align_end(F.get(ends, w["y"]), silences).alias("end_s"),
        ))

    kept = F.when(a <= b, F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(first.alias("a"), last.alias("b")))
    return let(kept, placed)
