"""Segmentation of word sequences: sentences, windows, captions, timing repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp, count_upto, let, millis
from quillspan.functions.text import clock_srt, ends_clause, ends_sentence

SOFT_WORDS, HARD_WORDS = 20, 35
GAP_S, HOLD_S = 0.4, 0.35


def _running(by: str, order: str = "idx") -> Window:
    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def sentence_islands(words: DataFrame) -> DataFrame:
    """Runs of words up to a sentence's end: doc_id, island, first, last, n_words, start_s, end_s."""
    island = F.coalesce(F.sum(ends_sentence(F.col("text")).cast("int")).over(_running("doc_id")), F.lit(0))
    return (
        words.withColumn("island", island)
        .groupBy("doc_id", "island")
        .agg(
            F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n_words"),
            F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        )
    )


def sentence_ranges(tokens: Column) -> Column:
    """Array of (first, last): breaks at sentence ends, at clause ends from 20 words on, and at 35 words.

    A fold inside the row, in the JVM; nothing is shuffled for it.
    """
    marks = F.transform(tokens, lambda w: F.when(ends_sentence(w), 2).when(ends_clause(w), 1).otherwise(0))
    none = F.expr("cast(array() as array<struct<first: int, last: int>>)")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), none.alias("out"))

    def step(s: Column, mark: Column) -> Column:
        length = s["i"] - s["first"] + 1
        cut = (mark == 2) | ((length >= SOFT_WORDS) & (mark == 1)) | (length >= HARD_WORDS)
        out = F.array_append(s["out"], F.struct(s["first"].alias("first"), s["i"].alias("last")))
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(cut, s["i"] + 1).otherwise(s["first"]).alias("first"),
            F.when(cut, out).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        rest = F.array_append(s["out"], F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last")))
        return F.when(s["first"] < s["i"], rest).otherwise(s["out"])

    return F.aggregate(marks, start, step, finish)


def sentences(lists: DataFrame) -> DataFrame:
    """doc_id, sid, first, last, n_words, text from rows of doc_id and tokens."""
    each = lists.select("doc_id", "tokens", F.posexplode(sentence_ranges(F.col("tokens"))).alias("sid", "s"))
    n = F.col("s.last") - F.col("s.first") + 1
    return each.select(
        "doc_id", "sid", "s.first", "s.last", n.alias("n_words"),
        F.array_join(F.slice("tokens", F.col("s.first") + 1, n), " ").alias("text"),
    )


def repaired(words: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Timings in order of start: no shorter than the text needs, no longer than up to the next word."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start, text = F.greatest(F.lit(0.0), F.col("start_s")), F.trim("text")
    clean = words.filter(F.trim("text") != "").select(
        *keys, *[c for c in order if c != "start_s"], text.alias("text"),
        start.alias("start_s"), F.greatest("start_s", "end_s").alias("end_s"),
    )
    least = F.col("start_s") + clamp(F.length("text") * 0.045, 0.08, 0.6)
    after = F.lead("start_s").over(w)
    end = F.greatest("end_s", least)
    upto = F.greatest(F.col("start_s") + 0.02, after)
    return clean.withColumn("end_s", F.when(after.isNull(), end).otherwise(F.least(end, upto)))


def transcript_windows(lists: DataFrame, window_s: float, overlap_s: float) -> DataFrame:
    """Overlapping windows of words; the next begins at the word spoken ``overlap_s`` before the last one's end.

    ``lists`` has doc_id and the arrays starts and ends. A fold inside the row over as many steps as windows.
    """
    none = F.expr("cast(array() as array<struct<first: int, last: int, duration_s: double>>)")

    def windows(t: Column) -> Column:
        starts, ends, n = t["starts"], t["ends"], F.size(t["ends"])

        def step(s: Column, _: Column) -> Column:
            cursor = s["cursor"]

            def window(last: Column) -> Column:
                seen = count_upto(starts, F.get(ends, last) - overlap_s) - 1
                after = F.when(last >= n - 1, n).otherwise(F.greatest(cursor + 1, F.greatest(F.lit(0), seen)))
                one = F.struct(cursor.alias("first"), last.alias("last"), (F.get(ends, last) - F.get(starts, cursor)).alias("duration_s"))
                return F.struct(after.alias("cursor"), F.array_append(s["out"], one).alias("out"))

            # Ends rise, so those in the window are the first so many.
            fit = count_upto(ends, F.get(starts, cursor) + window_s) - 1
            return F.when(cursor >= n, s).otherwise(let(F.greatest(cursor, fit), window))

        steps = F.sequence(F.lit(0), F.ceil(F.element_at(ends, -1) / (window_s - overlap_s)).cast("int") * 2 + 1)
        return F.aggregate(steps, F.struct(F.lit(0).alias("cursor"), none.alias("out")), step, lambda s: s["out"])

    found = let(F.struct("starts", "ends"), windows)
    return lists.select("doc_id", F.posexplode(found).alias("win", "w")).select("doc_id", "win", "w.first", "w.last", "w.duration_s")


def caption_groups(words: DataFrame, most: int, gap_s: float = GAP_S) -> DataFrame:
    """doc_id, grp, first, start_s, end_s (of the last word), hold_s, text.

    Hard breaks after sentences and pauses; inside a run a group ends after ``most`` words, so its number
    follows from the place in the run: windows only.
    """
    w = Window.partitionBy("doc_id").orderBy("idx")
    before = F.lag("end_s").over(w)
    hard = F.coalesce((F.col("start_s") - before > gap_s) | ends_sentence(F.lag("text").over(w)), F.lit(True))
    runs = words.withColumn("run", F.sum(hard.cast("int")).over(w))
    place = F.floor((F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("idx")) - 1) / most)
    groups = (
        runs.withColumn("part", place)
        .groupBy("doc_id", "run", "part")
        .agg(
            F.min("idx").alias("first"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"),
        )
    )
    g = Window.partitionBy("doc_id").orderBy("first")
    after = F.lead("start_s").over(g)
    hold = F.greatest(F.col("end_s"), F.least(after, F.col("end_s") + HOLD_S))  # least skips a missing next group
    return groups.select(
        "doc_id", (F.row_number().over(g) - 1).alias("grp"), "first", "start_s", "end_s", hold.alias("hold_s"), "text"
    )


def caption_list(tokens: Column, starts: Column, ends: Column, most: int, gap_s: float = GAP_S, texts: bool = True) -> Column:
    """The groups of ``caption_groups`` as an array of (first, last, start_s, end_s, hold_s, text), from the arrays of one transcript.

    Hard breaks are found first, each run is cut every ``most`` words: linear, and nothing is shuffled for it. Without ``texts`` there is no text.
    """

    def firsts(t: Column) -> Column:
        n = F.size(t["tokens"])
        after = lambda k: (F.get(t["starts"], k) - F.get(t["ends"], k - 1) > gap_s) | ends_sentence(F.get(t["tokens"], k - 1))
        breaks = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(after(k), F.lit(True)))
        cut = lambda b: F.flatten(F.transform(b, lambda h, k: F.sequence(h, F.coalesce(F.get(b, k + 1), n) - 1, F.lit(most))))
        return let(let(breaks, cut), lambda g: groups(t, g, n))

    def groups(t: Column, g: Column, n: Column) -> Column:
        def group(first: Column, last: Column) -> Column:
            end, after = F.get(t["ends"], last), F.get(t["starts"], last + 1)
            text = [F.array_join(F.slice(t["tokens"], first + 1, last - first + 1), " ").alias("text")] if texts else []
            return F.struct(
                first.alias("first"), last.alias("last"), F.get(t["starts"], first).alias("start_s"), end.alias("end_s"),
                F.greatest(end, F.least(after, end + HOLD_S)).alias("hold_s"), *text,
            )

        return F.transform(g, lambda first, k: let(F.coalesce(F.get(g, k + 1), n) - 1, lambda last: group(first, last)))

    return let(F.struct(tokens.alias("tokens"), starts.alias("starts"), ends.alias("ends")), firsts)


def captions(lists: DataFrame, most: int) -> DataFrame:
    """``caption_groups`` of transcripts that are rows: doc_id, tokens, starts, ends (of words in order)."""
    # Outer, as no list is empty: for an inner one Spark would add a filter on the list's size and make it twice.
    each = lists.select("doc_id", F.posexplode_outer(caption_list(F.col("tokens"), F.col("starts"), F.col("ends"), most)).alias("grp", "g"))
    return each.select("doc_id", "grp", "g.first", "g.start_s", "g.end_s", "g.hold_s", "g.text")


def _cue(grp: Column, start_s: Column, end_s: Column, text: Column) -> Column:
    times = F.concat(clock_srt(millis(start_s)), F.lit(" --> "), clock_srt(millis(end_s)))
    return F.concat_ws("\n", (grp + 1).cast("string"), times, text, F.lit(""))


def srt(words: DataFrame, most: int = 8) -> DataFrame:
    """doc_id and its captions as one SRT text."""
    cues = caption_groups(words, most).select("doc_id", "grp", _cue(F.col("grp"), F.col("start_s"), F.col("end_s"), F.col("text")).alias("cue"))
    ordered = F.array_sort(F.collect_list(F.struct("grp", "cue")))
    return cues.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["cue"]), "\n").alias("srt"))


def srt_of(lists: DataFrame, most: int = 8) -> DataFrame:
    """``srt`` of transcripts that are rows."""
    groups = caption_list(F.col("tokens"), F.col("starts"), F.col("ends"), most)
    cues = F.transform(groups, lambda g, k: _cue(k, g["start_s"], g["end_s"], g["text"]))
    return lists.select("doc_id", F.array_join(cues, "\n").alias("srt"))
