"""What replies must keep to: triage, scores, verdicts, pairs of the same story, proposals; and requests.

Every contract takes replies (keys, text) and the rows that were asked for, and gives the usable rows and one status a reply.
A reply's items become rows at once, so a long reply is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import let, ten, text_of, unit, whole
from quillspan.functions.text import sentence_ref
from quillspan.operators.replies import ITEM, coverage, field, parsed
from quillspan.sources import store

# Kinds of moments and content, and the dimensions of a score.
MOMENT_TYPES = (
    "strong_opening surprising_statement controversial_opinion emotional_moment admission punchline story_payoff insight advice "
    "curiosity_gap disagreement revelation question_answer gameplay_highlight reaction other"
).split()
CONTENT_TYPES = "stream gaming podcast interview educational commentary general".split()
DIMENSIONS = (
    "hook context payoff emotion curiosity quotability usefulness surprise storytelling retention opening ending completeness".split()
)
#: Usable share of the rows asked for, below which a reply is incomplete.
TRIAGE, SCORING, JUDGMENT, PAIRS = 0.5, 0.67, 0.7, 0.5
MOST_TAGS = 8


def entries(replies: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The items of a reply's list: keys, pos, item (null where the item is no object) and the item as a variant, for the kinds of its fields."""
    read = replies.select(*keys, parsed(F.col("text"), names).alias("_p"))
    # Outer and a filter after it: for an inner one Spark adds a filter on the list's size, which parses every reply twice.
    each = read.select(*keys, F.posexplode_outer("_p.items").alias("pos", "json")).filter("pos is not null")
    return each.select(*keys, "pos", F.when(F.col("json").startswith("{"), F.from_json("json", ITEM)).alias("item"), F.try_parse_json("json").alias("variant"))


def is_kind(variant: Column, name: str, kind: str) -> Column:
    """Whether a field of an item is a BOOLEAN or a STRING, not something that can be read as one."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant")) == kind, F.lit(False))


def named(rows: DataFrame) -> DataFrame:
    """Items whose candidate_id is a text; a number that looks like an id is none."""
    return rows.filter(is_kind(F.col("variant"), "candidate_id", "STRING"))


def moment_type(value: Column, kinds: list[str] = MOMENT_TYPES) -> Column:
    name = F.lower(text_of(value, 40))
    return F.when(name.isin(kinds), name)


def covered(rows: DataFrame, known: DataFrame, keys: list[str], ids: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """The last usable row of every id that was asked for, and (keys, got, expected, status) for every reply.

    ``rows``: keys, ids, pos and values; ``known``: keys, ids. Partial aggregations on both sides of one join. The usable rows are
    written once (``store.cut``), as both results read them and replies are dear to parse.
    """
    on = [*keys, *ids]
    values = [c for c in rows.columns if c not in (*on, "pos")]
    asked = known.select(*on).distinct()
    last = rows.join(asked, on, "left_semi").groupBy(*on).agg(F.max_by(F.struct(*values), "pos").alias("_v"))
    last = store.cut(last).select(*on, "_v.*")
    expected = asked.groupBy(*keys).agg(F.count("*").alias("expected"))
    got = expected.join(last.groupBy(*keys).agg(F.count("*").alias("got")), keys, "left")
    status = got.select(*keys, F.coalesce("got", F.lit(0)).alias("got"), "expected", coverage(F.col("got"), F.col("expected"), least).alias("status"))
    return last, status


def triage(replies: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, candidate_id, keep, priority, deep, kind."""
    e = named(entries(replies, keys, ["decisions", "candidates", "clips"]))
    item = F.col("item")
    rows = e.select(
        *keys, "pos", item["candidate_id"].alias("candidate_id"), unit(item["keep"]).alias("keep"), unit(item["priority"]).alias("priority"),
        F.coalesce(unit(item["needs_deep_reasoning"]), F.lit(0.0)).alias("deep"), moment_type(item["moment_type"]).alias("kind"),
    )
    return covered(rows.filter("keep is not null and priority is not null"), known, keys, ["candidate_id"], TRIAGE)


def scoring(replies: DataFrame, known: DataFrame, keys: list[str], sentences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """keys, candidate_id, dims, overall, kind, topic, title, contained, first, last.

    At least half of the dimensions (rounded down) and the overall score must be readable. Suggested edges count if they lie in
    the context that was shown; ``known`` has context_first and context_last besides the ids. With ``sentences`` (keys, sid, first, last) context and
    edges are numbers of sentences, a span may be one sentence, and the result has the words it begins and ends with.
    """
    e = named(entries(replies, keys, ["scores", "candidates"]))
    item = F.col("item")
    nested = F.from_json(item["scores"], ITEM)
    source = F.when(item["scores"].startswith("{"), nested).otherwise(item)
    names = F.array(*(F.lit(d) for d in DIMENSIONS))
    each = lambda m: F.transform(names, lambda d: let(m[d], lambda v: F.struct(d.alias("key"), ten(v).alias("value"))))
    # The map is made once a row: names and values are bound before they are used.
    dims = let(source, lambda m: F.map_from_entries(F.filter(each(m), lambda x: x["value"].isNotNull())))
    rows = e.select(
        *keys, "pos", item["candidate_id"].alias("candidate_id"), dims.alias("dims"), unit(item["overall"]).alias("overall"),
        moment_type(item["moment_type"]).alias("kind"), text_of(item["topic"], 60).alias("topic"), text_of(item["title"], 80).alias("title"),
        F.when(is_kind(F.col("variant"), "self_contained", "BOOLEAN"), item["self_contained"] == "true").alias("contained"),
        *((whole(item[f"{side}_word_index"]) if sentences is None else sentence_ref(item[f"{side}_sentence"]).cast("long")).alias(to) for side, to in (("start", "_first"), ("end", "_last"))),
    )
    usable = rows.filter(F.col("overall").isNotNull() & (F.size("dims") >= len(DIMENSIONS) // 2))
    last, status = covered(usable, known, keys, ["candidate_id"], SCORING)
    shown = last.join(known.select(*keys, "candidate_id", "context_first", "context_last"), [*keys, "candidate_id"])
    span = F.col("_first") < F.col("_last") if sentences is None else F.col("_first") <= F.col("_last")
    inside = (F.col("context_first") <= F.col("_first")) & span & (F.col("_last") <= F.col("context_last"))
    edge = lambda name: F.when(inside, F.col(f"_{name}")).alias(name)
    found = shown.select("*", edge("first"), edge("last")).drop("_first", "_last", "context_first", "context_last")
    return (found if sentences is None else _words_of(found, sentences, keys)), status


def _words_of(found: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, candidate_id, first, last as sentences) with the words they begin and end with: both edges as rows, one join, one aggregation."""
    both = F.explode(F.array(F.struct(F.lit(True).alias("begins"), F.col("first").alias("sid")), F.struct(F.lit(False).alias("begins"), F.col("last").alias("sid"))))
    edges = found.filter("first is not null").select(*keys, "candidate_id", both.alias("e")).select(*keys, "candidate_id", "e.*")
    words = edges.join(sentences.select(*keys, "sid", F.col("first").alias("_a"), F.col("last").alias("_b")), [*keys, "sid"])
    spans = words.groupBy(*keys, "candidate_id").agg(F.max(F.when(F.col("begins"), F.col("_a"))).alias("first"), F.max(F.when(~F.col("begins"), F.col("_b"))).alias("last"))
    return found.drop("first", "last").join(spans, [*keys, "candidate_id"], "left")


def hashtags(value: Column) -> Column:
    """The texts of a JSON list as tags: one # in front, no blanks, at most eight."""
    tags = F.from_json(value, "array<string>")
    clean = F.transform(tags, lambda t: F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(t, "^#+", ""), r"\s+", "")))
    return F.slice(F.filter(F.coalesce(clean, F.expr("cast(array() as array<string>)")), lambda t: F.length(t) > 1), 1, MOST_TAGS)


def judgment(replies: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, candidate_id, keep, score, title, reason, caption, tags, same_story_as.

    ``keep`` must be a boolean. Links to the same story count only to other finalists of the same reply.
    """
    e = named(entries(replies, keys, ["verdicts", "candidates", "clips"]))
    item = F.col("item")
    finalists = known.groupBy(*keys).agg(F.collect_set("candidate_id").alias("_known"))
    same = F.coalesce(F.from_json(item["same_story_as"], "array<string>"), F.expr("cast(array() as array<string>)"))
    rows = e.filter(is_kind(F.col("variant"), "keep", "BOOLEAN")).select(
        *keys, "pos", item["candidate_id"].alias("candidate_id"), (item["keep"] == "true").alias("keep"), unit(item["score"]).alias("score"),
        text_of(item["title"], 80).alias("title"), text_of(item["reason"], 300).alias("reason"),
        F.nullif(text_of(item["post_caption"], 300), F.lit("")).alias("caption"), hashtags(item["hashtags"]).alias("tags"), same.alias("_same"),
    )
    last, status = covered(rows.filter("score is not null"), known, keys, ["candidate_id"], JUDGMENT)
    linked = F.filter("_same", lambda s: (s != F.col("candidate_id")) & F.array_contains("_known", s))
    return last.join(finalists, keys).select("*", linked.alias("same_story_as")).drop("_same", "_known"), status


def pairs(replies: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, a, b, risk for the pairs asked for, whichever way round the reply has them."""
    e = entries(replies, keys, ["pairs"])
    item = F.col("item")
    rows = e.select(*keys, "pos", item["a"].alias("x"), item["b"].alias("y"), unit(item["same_story"]).alias("risk")).filter("risk is not null")
    both = rows.select(*keys, "pos", F.col("x").alias("a"), F.col("y").alias("b"), "risk").unionByName(
        rows.filter("x != y").select(*keys, "pos", F.col("y").alias("a"), F.col("x").alias("b"), "risk")
    )
    return covered(both, asked, keys, ["a", "b"], PAIRS)


def discovery(replies: DataFrame, sentences: DataFrame | None, keys: list[str], most: int, kinds: list[str] = MOMENT_TYPES) -> tuple[DataFrame, DataFrame]:
    """Proposals (keys, place, first, last, kind, score, title, hook, reason) and (keys, content_type, found, invalid, status).

    ``replies``: keys, text, window_first, window_last (words) and, with ``sentences`` (keys, sid, first, last), first_sid and last_sid:
    items then name sentences, cut to the window's. Items without a readable range in the window are invalid; a
    reply all of whose items are is refused. Of the others the first ``most`` are kept.
    """
    names = ["candidates", "clips", "moments"]
    read = replies.withColumn("_p", parsed(F.col("text"), names))
    each = read.select(*[c for c in replies.columns if c != "text"], F.posexplode_outer("_p.items").alias("pos", "json")).filter("pos is not null")
    item = F.when(F.col("json").startswith("{"), F.from_json("json", ITEM))
    each = each.withColumn("item", item)
    if sentences is None:
        each = each.withColumn("_a", whole(field(F.col("item"), "start_word_index", "start"))).withColumn("_b", whole(field(F.col("item"), "end_word_index", "end")))
    else:
        a, b = sentence_ref(F.col("item")["start_sentence"]), sentence_ref(F.col("item")["end_sentence"])
        fits = (b >= F.col("first_sid")) & (a <= F.col("last_sid")) & (b >= a)
        each = each.withColumn("_sa", F.when(fits, F.greatest("first_sid", a))).withColumn("_sb", F.when(fits, F.least("last_sid", b)))
        edge = lambda sid, word, out: sentences.select(*keys, F.col("sid").alias(sid), F.col(word).alias(out))
        each = each.join(edge("_sa", "first", "_a"), [*keys, "_sa"], "left").join(edge("_sb", "last", "_b"), [*keys, "_sb"], "left")
    first, last = F.greatest("window_first", "_a"), F.least("window_last", "_b")
    apart = (F.col("_b") < F.col("window_first")) | (F.col("_a") > F.col("window_last"))
    valid = F.coalesce(~apart & (last > first), F.lit(False))
    rows = each.select(
        *keys, "pos", valid.alias("valid"), first.alias("first"), last.alias("last"),
        F.coalesce(moment_type(field(F.col("item"), "type", "moment_type"), kinds), F.lit("other")).alias("kind"),
        F.coalesce(unit(field(F.col("item"), "initial_score", "score")), F.lit(0.5)).alias("score"), text_of(F.col("item")["title"], 80).alias("title"),
        text_of(F.col("item")["hook"], 200).alias("hook"), text_of(F.col("item")["reason"], 300).alias("reason"),
    )
    counts = rows.groupBy(*keys).agg(F.count_if("valid").alias("found"), F.count_if(~F.col("valid")).alias("invalid"))
    kind = F.lower(text_of(F.col("_p.content_type"), 30))
    heads = read.select(
        *keys, F.when(kind.isin(CONTENT_TYPES), kind).otherwise("general").alias("content_type"),
        F.when(F.col("_p").isNull(), "malformed").when(F.col("_p.items").isNull(), "schema").alias("_failed"),
    )
    joined = heads.join(counts, keys, "left")
    status = F.coalesce("_failed", F.when((F.col("found") == 0) & (F.col("invalid") > 0), "invalid_references").otherwise("ok"))
    n = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    kept = rows.filter("valid").withColumn("place", place).filter(F.col("place") <= max(1, most)).drop("pos", "valid")
    return kept, joined.select(*keys, "content_type", n("found"), n("invalid"), status.alias("status"))


def requests(rows: DataFrame, models: DataFrame, most_chars: int) -> DataFrame:
    """Requests (model, system, user, max_tokens, temperature) with ``problem`` (null: fine) and the limits that hold.

    ``models``: model, max_output. An unknown model or a blank prompt is a bad request, a long prompt too large. The tokens
    are kept between 256 and the model's most (which also serves if none are given), a temperature outside 0 to 1.5 is dropped.
    """
    asked = rows.join(F.broadcast(models.withColumn("_known", F.lit(True))), "model", "left")
    chars = F.length("system") + F.length("user")
    problem = (
        F.when(F.col("_known").isNull() | F.col("system").isNull() | (F.trim(F.coalesce("user", F.lit(""))) == ""), "bad_request")
        .when(chars > most_chars, "too_large")
    )
    given = F.greatest(F.lit(256), F.least(F.floor("max_tokens"), "max_output"))
    tokens = F.when(F.col("max_tokens").isNull(), F.col("max_output")).otherwise(given)
    return asked.select(
        *rows.columns, problem.alias("problem"), tokens.alias("tokens"), F.when(F.col("temperature").between(0, 1.5), F.col("temperature")).alias("heat")
    )
