"""Queries over the contracts of replies and requests, on replies made from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.numbers import millis
from quillspan.operators import contracts
from quillspan.plans.replies import _ITEMS, _K, _TEN, _UNIT, _item_rows
from quillspan.sources.adapters import table

KEYS = ["user_id", "reply"]
#: A kind for every class of event; the last is none that is known.
KIND = {0: "Insight", 1: " punchline ", 2: "dance"}


def _id(event: str = "event_id") -> Column:
    return F.concat(F.lit("c"), F.col(event).cast("string"))


def _kind() -> Column:
    return F.when(F.col("event_id") % 3 == 0, KIND[0]).when(F.col("event_id") % 3 == 1, KIND[1]).otherwise(KIND[2])


def _replies(rows: DataFrame, name: str, item: Column, head: str = "") -> DataFrame:
    """One reply text per (user, reply) with the items as a list under ``name``."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.to_json(item).alias("j"))))
    lists = rows.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["j"]), ",\n").alias("l"))
    text = F.concat(F.lit(f'Here {{it}} is:\n{{{head}"{name}": ['), F.col("l"), F.lit("],}"))
    return lists.select(*KEYS, text.alias("text"))


def _known(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.filter("event_id % 5 != 4").select(*KEYS, _id().alias("candidate_id"), *more)


def triage_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _item_rows(spark, sf_dir)
    item = F.struct(
        _id().alias("candidate_id"), F.when(F.col("event_id") % 7 != 0, F.col("s")).alias("keep"), (F.col("s") % 11).alias("priority"),
        (F.col("s") % 2 == 0).alias("needs_deep_reasoning"), _kind().alias("moment_type"),
    )
    last, status = contracts.triage(_replies(rows, "decisions", item), _known(rows), KEYS)
    each = last.select(*KEYS, "candidate_id", millis(F.col("keep")).alias("keep_1e3"), millis(F.col("priority")).alias("priority_1e3"), F.col("deep").cast("int").alias("deep"), "kind")
    return status.join(each, KEYS, "left")


def scoring_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions nested under scores or beside them; every fourth item has too few of them."""
    rows = _item_rows(spark, sf_dir)
    dims = [F.when((F.col("event_id") % 4 != 0) | F.lit(k < 5), (F.col("s") + k) % 11).alias(d) for k, d in enumerate(contracts.DIMENSIONS[:8])]
    item = F.struct(
        _id().alias("candidate_id"), F.when(F.col("event_id") % 2 == 0, F.struct(*dims)).alias("scores"),
        *(F.when(F.col("event_id") % 2 == 1, d).alias(n) for d, n in zip(dims, contracts.DIMENSIONS, strict=False)),
        F.col("s").cast("string").alias("overall"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1).alias("self_contained"),
        F.col("a").alias("start_word_index"), F.col("b").cast("string").alias("end_word_index"), F.lit("  a topic ").alias("topic"),
    )
    known = _known(rows, F.lit(50).cast("long").alias("context_first"), F.lit(380).cast("long").alias("context_last"))
    last, status = contracts.scoring(_replies(rows, "scores", item), known, KEYS)
    total = F.aggregate(F.map_values("dims"), F.lit(0.0), lambda s, x: s + x)
    each = last.select(
        *KEYS, "candidate_id", F.size("dims").alias("n_dims"), millis(total).alias("dims_1e3"), millis(F.col("overall")).alias("overall_1e3"),
        "contained", "first", "last", F.length("topic").alias("topic_chars"),
    )
    return status.join(each, KEYS, "left")


def scoring_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with edges by sentence, written as 12, "12" or "s12"; every eleventh item has a number for an id, which is none. Sentences are ten words."""
    rows = _item_rows(spark, sf_dir)
    dims = [((F.col("s") + k) % 11).alias(d) for k, d in enumerate(contracts.DIMENSIONS[:6])]
    sid = lambda c: F.floor(F.col(c) / 10).cast("string")
    edge = lambda c: F.when(F.col("event_id") % 3 == 0, sid(c)).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), sid(c), F.lit('"'))).otherwise(F.concat(F.lit('"s'), sid(c), F.lit('"')))
    name = F.when(F.col("event_id") % 11 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), _id(), F.lit('"')))
    rest = F.to_json(F.struct(*dims, (F.col("s") / 100).alias("overall")))
    text = F.concat(F.lit('{"candidate_id": '), name, F.lit(', "start_sentence": '), edge("a"), F.lit(', "end_sentence": '), edge("b"), F.lit(", "), F.substring(rest, 2, 10_000))
    ordered = F.array_sort(F.collect_list(F.struct("pos", text.alias("j"))))
    lists = rows.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["j"]), ", ").alias("l"))
    replies = lists.select(*KEYS, F.concat(F.lit('{"scores": ['), F.col("l"), F.lit("]}")).alias("text"))
    known = _known(rows, F.lit(8).cast("long").alias("context_first"), F.lit(38).cast("long").alias("context_last"))
    known = known.withColumn("candidate_id", F.when(F.substring("candidate_id", 2, 20).cast("long") % 11 == 0, F.substring("candidate_id", 2, 20)).otherwise(F.col("candidate_id")))
    sentences = lists.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(50))).alias("sid"))
    sentences = sentences.select(*KEYS, "sid", (F.col("sid") * 10).cast("long").alias("first"), (F.col("sid") * 10 + 9).cast("long").alias("last"))
    last, status = contracts.scoring(replies, known, KEYS, sentences)
    return status.join(last.select(*KEYS, "candidate_id", "first", "last", millis(F.col("overall")).alias("overall_1e3")), KEYS, "left")


def judgment_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth verdict says keep as a text, which is no boolean; links go to the next event and to itself."""
    rows = _item_rows(spark, sf_dir)
    keep = F.when(F.col("event_id") % 6 == 0, F.lit('"true"')).when(F.col("s") > 50, F.lit("true")).otherwise(F.lit("false"))
    rest = F.to_json(
        F.struct(
            _id().alias("candidate_id"), F.col("s").alias("score"), F.lit("t").alias("title"),
            F.array(_id(), F.concat(F.lit("c"), (F.col("event_id") + 1).cast("string"))).alias("same_story_as"),
            F.array(F.lit("##big news"), F.lit("#"), F.lit("go")).alias("hashtags"),
        )
    )
    text = F.concat(F.lit('{"keep": '), keep, F.lit(", "), F.substring(rest, 2, 10_000))
    ordered = F.array_sort(F.collect_list(F.struct("pos", text.alias("j"))))
    lists = rows.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["j"]), ", ").alias("l"))
    replies = lists.select(*KEYS, F.concat(F.lit('{"verdicts": ['), F.col("l"), F.lit("]}")).alias("text"))
    last, status = contracts.judgment(replies, _known(rows), KEYS)
    each = last.select(
        *KEYS, "candidate_id", "keep", millis(F.col("score")).alias("score_1e3"), F.array_join("tags", " ").alias("tags"),
        F.array_join("same_story_as", ",").alias("same_story_as"),
    )
    return status.join(each, KEYS, "left")


def pair_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring items; answers come the other way round for odd events."""
    rows = _item_rows(spark, sf_dir)
    a, b = _id(), F.concat(F.lit("c"), (F.col("event_id") * 2).cast("string"))
    odd = F.col("event_id") % 2 == 1
    item = F.struct(F.when(odd, b).otherwise(a).alias("a"), F.when(odd, a).otherwise(b).alias("b"), F.when(F.col("event_id") % 9 != 0, F.col("s")).alias("same_story"))
    asked = rows.filter("event_id % 5 != 4").select(*KEYS, a.alias("a"), b.alias("b"))
    last, status = contracts.pairs(_replies(rows, "pairs", item), asked, KEYS)
    return status.join(last.select(*KEYS, "a", "b", millis(F.col("risk")).alias("risk_1e3")), KEYS, "left")


def sentence_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals by sentence: sentences of ten words, those of a window are 10 to 40."""
    rows = _item_rows(spark, sf_dir)
    item = F.struct(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), F.floor(F.col("a") / 10).cast("string"))).otherwise(F.floor(F.col("a") / 10).cast("string")).alias("start_sentence"),
        F.floor(F.col("b") / 10).alias("end_sentence"), _kind().alias("type"), F.when(F.col("event_id") % 8 != 0, F.col("s")).alias("initial_score"),
        F.concat(F.lit(" hook "), F.col("event_id").cast("string"), F.lit(" ")).alias("hook"), F.repeat(F.lit("r"), (F.col("event_id") % 40 + 280).cast("int")).alias("reason"),
    )
    replies = _replies(rows, "clips", item, '"content_type": "Podcast", ').select(
        "*", F.lit(100).cast("long").alias("window_first"), F.lit(400).cast("long").alias("window_last"), F.lit(10).alias("first_sid"), F.lit(40).alias("last_sid")
    )
    sentences = replies.select(*KEYS, F.explode(F.sequence(F.lit(10), F.lit(40))).alias("sid"))
    sentences = sentences.select(*KEYS, "sid", (F.col("sid") * 10).cast("long").alias("first"), (F.col("sid") * 10 + 9).cast("long").alias("last"))
    kept, heads = contracts.discovery(replies, sentences, KEYS, 5)
    each = kept.select(*KEYS, F.col("place").cast("long").alias("place"), "first", "last", "kind", millis(F.col("score")).alias("score_1e3"), "hook", F.length("reason").alias("reason_chars"))
    return heads.join(each, KEYS, "left")


def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests to the nations' models."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        "conv_id", "turn", (F.col("conv_id") % 30).alias("model"), F.when(F.col("turn") % 7 != 6, "s").alias("system"), F.col("text").alias("user"),
        F.when(F.col("turn") % 3 > 0, F.col("conv_id") % 900).alias("max_tokens"), (F.col("turn") * 0.4).alias("temperature"),
    )
    models = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("model"), (F.lit(300) + F.col("n_nationkey") * 10).alias("max_output"))
    out = contracts.requests(rows, models, 600)
    return out.select("conv_id", "turn", "problem", F.col("tokens").cast("long").alias("tokens"), millis(F.col("heat")).alias("heat_1e3"))


def _status(usable: str, least: float) -> str:
    return f"""asked AS (SELECT user_id, reply, count(*) AS expected FROM rows_ WHERE event_id % 5 <> 4 GROUP BY ALL),
    u AS (SELECT * FROM rows_ WHERE event_id % 5 <> 4 AND {usable}),
    st AS (SELECT a.user_id, a.reply, coalesce(got, 0) AS got, expected,
      CASE WHEN got IS NULL THEN 'schema' WHEN got / expected < {least}::DOUBLE THEN 'incomplete' ELSE 'ok' END AS status
      FROM asked a LEFT JOIN (SELECT user_id, reply, count(*) AS got FROM u GROUP BY ALL) g USING (user_id, reply))"""


def _score(value: str, there: str = "event_id") -> str:
    """A value on the scale of 0 to 1 in thousandths; null for a reply without usable rows (greatest and least skip nulls)."""
    return f"CASE WHEN {there} IS NOT NULL THEN {_K.format(_UNIT.format(value))} END"


_KIND_SQL = "CASE event_id % 3 WHEN 0 THEN 'insight' WHEN 1 THEN 'punchline' END"
_DIM = " + ".join(f"CASE WHEN event_id % 4 <> 0 OR {k} < 5 THEN {_TEN.format(f'((s + {k}) % 11)')} ELSE 0 END" for k in range(8))

QUERIES = {
    "triage_contract": (
        triage_contract,
        f"""WITH {_ITEMS}, {_status('event_id % 7 <> 0', contracts.TRIAGE)}
        SELECT st.*, 'c' || event_id AS candidate_id, {_score('s')} AS keep_1e3, {_score('(s % 11)')} AS priority_1e3,
          CASE WHEN event_id IS NULL THEN NULL WHEN s % 2 = 0 THEN 1 ELSE 0 END AS deep, {_KIND_SQL} AS kind FROM st LEFT JOIN u USING (user_id, reply)""",
    ),
    "scoring_details": (
        scoring_details,
        f"""WITH {_ITEMS}, {_status('event_id % 4 <> 0', contracts.SCORING)}
        SELECT st.*, 'c' || event_id AS candidate_id, CASE WHEN event_id IS NOT NULL THEN 8 END AS n_dims,
          {_K.format(_DIM)} + CASE WHEN event_id IS NULL THEN NULL ELSE 0 END AS dims_1e3, {_score('s')} AS overall_1e3,
          CASE event_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS contained,
          CASE WHEN a >= 50 AND a < b AND b <= 380 THEN a END AS first, CASE WHEN a >= 50 AND a < b AND b <= 380 THEN b END AS last,
          CASE WHEN event_id IS NOT NULL THEN 7 END AS topic_chars FROM st LEFT JOIN u USING (user_id, reply)""",
    ),
    "scoring_sentences": (
        scoring_sentences,
        f"""WITH {_ITEMS}, {_status('event_id % 11 <> 0', contracts.SCORING)}, x AS (SELECT *, CAST(floor(a / 10) AS BIGINT) AS sa, CAST(floor(b / 10) AS BIGINT) AS sb FROM u)
        SELECT st.*, 'c' || event_id AS candidate_id, CASE WHEN sa >= 8 AND sa <= sb AND sb <= 38 THEN sa * 10 END AS first,
          CASE WHEN sa >= 8 AND sa <= sb AND sb <= 38 THEN sb * 10 + 9 END AS last, CASE WHEN event_id IS NOT NULL THEN {_K.format(_UNIT.format('(s / 100)'))} END AS overall_1e3
        FROM st LEFT JOIN x USING (user_id, reply)""",
    ),
    "judgment_contract": (
        judgment_contract,
        f"""WITH {_ITEMS}, {_status('event_id % 6 <> 0', contracts.JUDGMENT)}
        SELECT st.*, 'c' || u.event_id AS candidate_id, u.s > 50 AS keep, {_score('u.s', 'u.event_id')} AS score_1e3,
          CASE WHEN u.event_id IS NOT NULL THEN '#bignews #go' END AS tags,
          CASE WHEN u.event_id IS NOT NULL THEN CASE WHEN n.event_id IS NOT NULL THEN 'c' || n.event_id ELSE '' END END AS same_story_as
        FROM st LEFT JOIN u USING (user_id, reply)
        LEFT JOIN rows_ n ON n.user_id = u.user_id AND n.reply = u.reply AND n.event_id = u.event_id + 1 AND n.event_id % 5 <> 4""",
    ),
    "pair_contract": (
        pair_contract,
        f"""WITH {_ITEMS}, {_status('event_id % 9 <> 0', contracts.PAIRS)}
        SELECT st.*, 'c' || event_id AS a, 'c' || event_id * 2 AS b, {_score('s')} AS risk_1e3 FROM st LEFT JOIN u USING (user_id, reply)""",
    ),
    "sentence_discovery": (
        sentence_discovery,
        f"""WITH {_ITEMS}, v AS (
          SELECT *, floor(a / 10) AS sa, floor(b / 10) AS sb, greatest(100, floor(a / 10) * 10) AS f, least(400, least(40, floor(b / 10)) * 10 + 9) AS l FROM rows_
        ), w AS (SELECT *, sb >= 10 AND sa <= 40 AND sb >= sa AND l > f AS ok FROM v
        ), h AS (SELECT user_id, reply, 'podcast' AS content_type, count(*) FILTER (WHERE ok) AS found, count(*) FILTER (WHERE NOT ok) AS invalid FROM w GROUP BY ALL
        ), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, reply ORDER BY pos) AS place FROM w WHERE ok)
        SELECT h.*, CASE WHEN found = 0 AND invalid > 0 THEN 'invalid_references' ELSE 'ok' END AS status, place, CAST(f AS BIGINT) AS first, CAST(l AS BIGINT) AS last,
          CASE WHEN place IS NOT NULL THEN coalesce({_KIND_SQL}, 'other') END AS kind,
          CASE WHEN place IS NULL THEN NULL WHEN event_id % 8 = 0 THEN 500 ELSE {_K.format(_UNIT.format('s'))} END AS score_1e3,
          CASE WHEN place IS NOT NULL THEN 'hook ' || event_id END AS hook, CASE WHEN place IS NOT NULL THEN CAST(least(300, event_id % 40 + 280) AS INT) END AS reason_chars
        FROM h LEFT JOIN (SELECT * FROM p WHERE place <= 5) USING (user_id, reply)""",
    ),
    "request_limits": (
        request_limits,
        """SELECT conv_id, turn, CASE WHEN n_nationkey IS NULL OR turn % 7 = 6 OR trim(coalesce(text, '')) = '' THEN 'bad_request'
            WHEN 1 + length(text) > 600 THEN 'too_large' END AS problem,
          CAST(CASE WHEN n_nationkey IS NULL THEN CASE WHEN turn % 3 > 0 THEN greatest(256, conv_id % 900) END
            WHEN turn % 3 > 0 THEN greatest(256, least(conv_id % 900, 300 + n_nationkey * 10)) ELSE 300 + n_nationkey * 10 END AS BIGINT) AS tokens,
          CASE WHEN turn * 0.4::DOUBLE <= 1.5 THEN CAST(floor(turn * 0.4::DOUBLE * 1000 + 0.5) AS BIGINT) END AS heat_1e3
        FROM conversations LEFT JOIN nation ON n_nationkey = conv_id % 30""",
    ),
}
