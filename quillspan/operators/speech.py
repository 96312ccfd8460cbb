"""Speech in parts: word times around silences, padded chunks without doubles at the seams, ranges split until they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.numbers import count_upto, let, running
from quillspan.operators import intervals

# Least speech that counts, overlap of two halves, a range that is never split.
LEAST_SPEECH_S, SEAM_S, SMALLEST_S = 0.05, 0.5, 20.0
#: Share of failed parts that a whole still bears.
TOLERATED = 0.34
#: The type of a list of silences.
SPANS = "array<struct<start_s: double, end_s: double>>"


def speech_of(start: Column, end: Column, silences: Column) -> Column:
    """What lies between the silences of a row, as a struct: starts, ends, uptos (speech before each), total; the whole span if hardly anything does.

    Running maxima and sums over the sorted silences give the gaps between them, so the work is that of the sort.
    """

    def whole() -> Column:
        return F.struct(F.array(start).alias("starts"), F.array(end).alias("ends"), F.array(F.lit(0.0)).alias("uptos"), (end - start).alias("total"))

    def summed(gaps: Column) -> Column:
        length = lambda g: g["b"] - g["a"]
        some = lambda upto: F.struct(
            F.transform(gaps, lambda g: g["a"]).alias("starts"), F.transform(gaps, lambda g: g["b"]).alias("ends"),
            F.transform(gaps, lambda g, k: F.get(upto, k) - length(g)).alias("uptos"), F.get(upto, F.size(upto) - 1).alias("total"),
        )
        pick = lambda upto: F.when(F.get(upto, F.size(upto) - 1) > LEAST_SPEECH_S, some(upto)).otherwise(whole())
        return let(running(F.transform(gaps, length), lambda a, b: a + b, "double"), pick)

    def gaps_of(quiet: Column) -> Column:
        # A silence of no length at the end closes the last gap.
        at = lambda k: F.coalesce(F.get(quiet, k)["start_s"], end)
        between = lambda until: F.transform(
            F.sequence(F.lit(0), F.size(quiet)), lambda k: F.struct(F.greatest(start, F.coalesce(F.get(until, k - 1), start)).alias("a"), F.least(at(k), end).alias("b"))
        )
        spoken = lambda until: F.filter(between(until), lambda g: g["b"] > g["a"])
        return let(let(running(F.transform(quiet, lambda q: q["end_s"]), F.greatest, "double"), spoken), summed)

    inside = F.filter(F.coalesce(silences, F.expr(f"cast(array() as {SPANS})")), lambda q: (q["end_s"] > start) & (q["start_s"] < end))
    return let(F.array_sort(F.transform(inside, lambda q: F.struct(q["start_s"].alias("start_s"), q["end_s"].alias("end_s")))), gaps_of)


def estimated_words(rows: DataFrame) -> DataFrame:
    """doc_id, idx, text, start_s, end_s: tokens spread over the speech of a span by their length, leaving out its silences.

    ``rows``: doc_id, tokens, start_s, end_s, silences. Times are made in the row, each word's span of speech found by a binary search, and nothing
    is shuffled. An offset on a border belongs to the earlier span. A word ends where the next begins.
    """

    def spread(r: Column) -> Column:
        weights = F.transform(r["tokens"], lambda t: F.greatest(F.lit(1), F.length(t)) + 1)

        def placed(p: Column) -> Column:
            speech, upto = p["speech"], p["upto"]

            def at(k: Column) -> Column:
                def spoken(off: Column) -> Column:
                    span = lambda j: F.least(F.get(speech["ends"], j), F.get(speech["starts"], j) + off - F.get(speech["uptos"], j))
                    return let(F.greatest(F.lit(0), count_upto(speech["uptos"], off, below=True) - 1), span)

                return let(F.coalesce(F.get(upto, k - 1), F.lit(0)) / F.get(upto, F.size(upto) - 1) * speech["total"], spoken)

            # One edge more marks the end of the last word.
            edges = F.transform(F.sequence(F.lit(0), F.size(upto)), at)
            return let(edges, lambda e: F.transform(r["tokens"], lambda t, k: F.struct(t.alias("text"), F.get(e, k).alias("start_s"), F.get(e, k + 1).alias("end_s"))))

        parts = F.struct(speech_of(r["start_s"], r["end_s"], r["silences"]).alias("speech"), running(weights, lambda a, b: a + b, "bigint").alias("upto"))
        # Rows without words or time leave after the explode: a filter on the tokens would make them twice.
        return F.when((r["end_s"] > r["start_s"]) & (F.size(r["tokens"]) > 0), let(parts, placed))

    each = rows.select("doc_id", let(F.struct("tokens", "start_s", "end_s", "silences"), spread).alias("_w"))
    return each.select("doc_id", F.posexplode_outer("_w").alias("idx", "w")).filter("idx is not null").select("doc_id", "idx", "w.text", "w.start_s", "w.end_s")


def owns(chunk_start: Column, chunk_end: Column, is_last: Column) -> Column:
    """Whether the middle of a word (start_s, end_s) lies in the chunk, or after it if it is the last."""
    mid = (F.col("start_s") + F.col("end_s")) / 2
    return (mid >= chunk_start) & ((mid < chunk_end) | is_last)


def owned(words: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Words heard in padded chunks (key, chunk, start_s, end_s), each kept only by the chunk its middle lies in.

    ``chunks``: key, chunk, chunk_start, chunk_end; the last of a key also keeps what comes after it.
    """
    last = chunks.groupBy(key).agg(F.max("chunk").alias("_last"))
    bounds = chunks.join(last, key)
    inside = owns(F.col("chunk_start"), F.col("chunk_end"), F.col("chunk") == F.col("_last"))
    return words.join(bounds, [key, "chunk"]).filter(inside).drop("chunk_start", "chunk_end", "_last")


def owners(words: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Words (key, start_s, end_s) with the chunk their middle lies in, for chunks of any length: an as-of join."""
    timed = words.withColumn("_mid", (F.col("start_s") + F.col("end_s")) / 2)
    return intervals.as_of(timed, chunks.select(key, "chunk_start", "chunk"), [key], "_mid", "chunk_start", "chunk").drop("_mid")


def split_ranges(ranges: DataFrame, most_bytes: int) -> DataFrame:
    """Ranges (start_s, end_s, bytes_per_s, ...) halved until a part fits or is short: piece, start_s, end_s, own_from, own_to.

    Halves overlap by a second; a word belongs to the half that its middle lies in. A fold inside the row over the levels.
    """
    one = F.struct(
        F.col("start_s").cast("double").alias("a"), F.col("end_s").cast("double").alias("b"), F.lit(float("-inf")).alias("own_a"), F.lit(float("inf")).alias("own_b")
    )

    def halves(p: Column) -> Column:
        mid = (p["a"] + p["b"]) / 2
        left = F.struct(p["a"].alias("a"), (mid + SEAM_S).alias("b"), p["own_a"].alias("own_a"), F.least(p["own_b"], mid).alias("own_b"))
        right = F.struct((mid - SEAM_S).alias("a"), p["b"].alias("b"), F.greatest(p["own_a"], mid).alias("own_a"), p["own_b"].alias("own_b"))
        big = ((p["b"] - p["a"]) * F.col("bytes_per_s") > most_bytes) & (p["b"] - p["a"] > SMALLEST_S)
        return F.when(big, F.array(left, right)).otherwise(F.array(p))

    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2((F.col("end_s") - F.col("start_s")) / (SMALLEST_S - 2 * SEAM_S))).cast("int")))
    parts = F.aggregate(levels, F.array(one), lambda s, _: F.flatten(F.transform(s, halves)))
    rest = [c for c in ranges.columns if c not in ("start_s", "end_s")]
    each = ranges.select(*rest, F.posexplode(parts).alias("piece", "p"))
    return each.select(*rest, "piece", F.col("p.a").alias("start_s"), F.col("p.b").alias("end_s"), F.col("p.own_a").alias("own_from"), F.col("p.own_b").alias("own_to"))


def tolerance(parts: DataFrame, keys: list[str], share: float = TOLERATED) -> DataFrame:
    """keys, parts, failed, status: ok, partial (a share of failures that is borne) or failed. ``parts``: keys, ok."""
    counts = parts.groupBy(*keys).agg(F.count("*").alias("parts"), F.count_if(~F.col("ok")).alias("failed"))
    status = F.when(F.col("failed") == 0, "ok").when((F.col("failed") == F.col("parts")) | (F.col("failed") / F.col("parts") > share), "failed").otherwise("partial")
    return counts.withColumn("status", status)
