"""Model routing: who may answer, and how health follows from the log of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import intervals

#: Seconds of a slice of a log that one window goes over.
SLICE_S = 86_400.0
# Seconds that a model rests after a failure.
REST_S = {"rate_limit": 60.0, "timeout": 240.0}
REST_OTHER_S = 45.0
# Errors after which a model rests its 45 s whatever is asked for, and those that end a job.
REFUSED, ENDING = ["bad_request", "too_large"], ["auth", "not_configured"]
STRIKES, ROTATED, MOST_WAIT_S, HEDGE_S = 2, 3, 150.0, 20.0
BACKOFF_S, FATAL = [3.0, 8.0, 20.0, 40.0], ["auth", "not_configured", "bad_request", "too_large"]


def eligible(models: DataFrame, capability: str, providers: DataFrame) -> DataFrame:
    """Models that have the capability and a configured provider, best first. ``models``: id, provider, priority (map)."""
    have = models.filter(F.map_contains_key("priority", F.lit(capability))).join(providers, "provider", "left_semi")
    return have.select("id", "provider", F.col("priority")[capability].alias("place")).orderBy("place", "id")


def rest_s(category: Column, retry_after: Column | None = None) -> Column:
    usual = F.when(category == "rate_limit", REST_S["rate_limit"]).when(category == "timeout", REST_S["timeout"]).otherwise(REST_OTHER_S)
    return usual if retry_after is None else F.greatest(F.lit(1.0), F.coalesce(retry_after, usual))


def health(log: DataFrame, key: str) -> DataFrame:
    """Each call with the state it met: usable, failures and successes before it. ``log``: key, id, at_s, failed, category.

    A success ends a rest; so only the last call before matters, and windows suffice.
    """
    w = Window.partitionBy(key).orderBy("at_s", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    until = F.when(F.col("failed"), F.col("at_s") + rest_s(F.col("category"))).otherwise(0.0)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    return log.select(
        key, "id", (F.col("at_s") >= F.coalesce(F.lag(until).over(w), F.lit(0.0))).alias("usable"),
        count(F.col("failed")).alias("failures"), count(~F.col("failed")).alias("successes"),
    )


def call_stats(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(
        F.count("*").alias("calls"), F.count_if("failed").alias("failures"),
        F.max_by("id", F.when(~F.col("failed"), F.struct("at_s", "id"))).alias("last_ok"),
    )


def availability(log: DataFrame, job: str | None = None) -> DataFrame:
    """Each call of a log with why its model could not be used then: ended, provider, model, quality, resting, or null.

    ``log``: provider, model, capability, id, at_s, category (null: a success), retry_after. A provider that refuses the key and a model that is
    gone stay out from then on; two invalid answers end a model's use for that capability; a rest lasts until it is over or
    a success comes. With ``job``, a column, nothing outlives its job, and the first error that no model can help (no login, no key) ends it:
    that relation is one row a job. First times come from partial aggregations, rests and strikes from scans of two levels (``intervals.running``).
    """
    own = [job] if job else []
    when = F.struct("at_s", "id")
    off = lambda keys, categories, name: log.filter(F.col("category").isin(categories)).groupBy(*own, *keys).agg(F.min(when).alias(name))
    known = log.join(off(["provider"], ["provider_auth"], "_provider"), [*own, "provider"], "left").join(off(["model"], ["model_unavailable"], "_model"), [*own, "model"], "left")
    known = known.join(off([], ENDING, "_end"), own, "left") if job else known.withColumn("_end", F.lit(None).cast("struct<at_s: double, id: long>"))
    category = F.col("category")
    rest = (
        F.when(category.isNull(), 0.0).when(category.isin("provider_auth", "model_unavailable", "invalid", *ENDING), None)
        .otherwise(F.col("at_s") + rest_s(category, F.when(~category.isin("timeout", *REFUSED), F.col("retry_after"))))
    )
    order = [F.col("at_s"), F.col("id")]
    known = intervals.running(known, [*own, "model"], "at_s", order, last={"_until": rest}, before=True, slice_s=SLICE_S)
    known = intervals.running(known, [*own, "model", "capability"], "at_s", order, sums={"_strikes": (category == "invalid").cast("int")}, before=True, slice_s=SLICE_S)
    resting = F.col("at_s") < F.coalesce("_until", F.lit(0.0))
    why = (
        F.when(F.col("_end") < when, "ended").when(F.col("_provider") < when, "provider").when(F.col("_model") < when, "model")
        .when(F.col("_strikes") >= STRIKES, "quality").when(resting, "resting")
    )
    return known.withColumn("why_not", why).drop("_provider", "_model", "_end", "_until", "_strikes")


def rotated(models: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """The order in which asks (keys, capability, rotate) try models (model, capability, rank from 0): the first three turn by ``rotate``.

    Models are few; their side is broadcast with its size bounded by the caller's registry.
    """
    sized = models.withColumn("_n", F.least(F.lit(ROTATED), F.count("*").over(Window.partitionBy("capability"))))
    both = asks.join(F.broadcast(sized), "capability")
    turned = F.pmod(F.col("rank") - F.col("rotate"), F.col("_n"))
    return both.select(*keys, "capability", "model", F.when(F.col("rank") < F.col("_n"), turned).otherwise(F.col("rank")).cast("int").alias("place"))


def routed(order: DataFrame, rests: DataFrame, keys: list[str], most_s: float = MOST_WAIT_S) -> DataFrame:
    """Of each ask (keys, model, place, at_s) the model that answers: the first that does not rest, else the first to recover in time.

    ``rests``: model, until_s. keys, model, wait_s; no model where none recovers within ``most_s``.
    """
    timed = order.join(F.broadcast(rests), "model", "left").withColumn("until_s", F.coalesce("until_s", F.lit(0.0)))
    free = F.col("until_s") <= F.col("at_s")
    best = timed.groupBy(*keys).agg(
        F.min_by("model", F.when(free, F.col("place"))).alias("_now"),
        F.min(F.when(~free, F.struct("until_s", "place", "model", "at_s"))).alias("_later"),
    )
    wait = F.col("_later.until_s") - F.col("_later.at_s")
    late = F.col("_now").isNull() & (wait <= most_s)
    return best.select(*keys, F.coalesce("_now", F.when(late, F.col("_later.model"))).alias("model"), F.when(F.col("_now").isNotNull(), 0.0).when(late, F.greatest(F.lit(1.0), wait)).alias("wait_s"))


def raced(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of two attempts a request (keys, place 0 or 1, model, free, took_s, ok): keys, model, finish_s.

    The second begins when the first fails, or after 20 s beside it if it is free; the first valid answer wins.
    """
    pick = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    two = attempts.groupBy(*keys).agg(*(pick(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("model", "free", "took_s", "ok")))
    begins = F.when(F.col("free1") & (F.col("took_s0") > HEDGE_S), F.lit(HEDGE_S)).when(~F.col("ok0"), F.col("took_s0"))
    first = F.when(F.col("ok0"), F.struct(F.col("took_s0").alias("finish_s"), F.lit(0).alias("place"), F.col("model0").alias("model")))
    second = F.when(F.col("ok1") & begins.isNotNull(), F.struct((begins + F.col("took_s1")).alias("finish_s"), F.lit(1).alias("place"), F.col("model1").alias("model")))
    best = F.array_min(F.filter(F.array(first, second), lambda x: x.isNotNull()))
    return two.select(*keys, best["model"].alias("model"), best["finish_s"].alias("finish_s"))


def repaired_calls(calls: DataFrame, repairs: DataFrame, keys: list[str]) -> DataFrame:
    """Calls (keys, output, valid) with the output of their one repair where the first was invalid: keys, output, tries, valid."""
    second = repairs.select(*keys, F.col("output").alias("_o"), F.col("valid").alias("_v"))
    both = calls.join(second, keys, "left")
    again = ~F.col("valid") & F.col("_v").isNotNull()
    return both.select(*keys, F.when(again, F.col("_o")).otherwise(F.col("output")).alias("output"), F.when(again, 2).otherwise(1).alias("tries"), (F.col("valid") | F.coalesce("_v", F.lit(False))).alias("valid"))


def next_try(attempt: Column, category: Column, at_s: Column) -> Column:
    """When a failed try (numbered from 0) is tried again: after 3, 8, 20 and 40 s; null after the fifth or where trying is of no use."""
    wait = F.get(F.array(*(F.lit(x) for x in BACKOFF_S)), attempt)
    return F.when(~category.isin(FATAL), at_s + wait)
