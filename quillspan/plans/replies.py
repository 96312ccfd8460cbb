"""Queries over model replies, call logs, wire chunks, series and layouts, on carriers made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import half_up, let, millis, ten, unit
from quillspan.functions.spans import crop_size
from quillspan.functions.text import content_words, jaccard, slug
from quillspan.operators import layout, replies, routing, series
from quillspan.plans.transcripts import _CONTENT
from quillspan.sources import store, wire
from quillspan.sources.adapters import ENERGY_SQL, FRAME_S, SPANS_SQL, WORDS_SQL, energy, spans, table, word_lists

KINDS = ["view", "click", "signup"]
#: Calls of a window: events of a user, twenty to a reply.
PER_REPLY, CHUNK = 20, 37
#: Words of an event of a streamed completion.
EVENT_WORDS = 9


def _item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of replies: user_id, reply, pos, and word ranges that now and then miss the window 100..400."""
    rows = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = rows.withColumn("frame", F.row_number().over(w) - 1)
    a = F.col("event_id") % 450
    return numbered.select(
        "user_id", F.floor(F.col("frame") / PER_REPLY).cast("int").alias("reply"), (F.col("frame") % PER_REPLY).alias("pos"),
        a.alias("a"), (a + F.col("event_id") % 60 - 5).alias("b"), "event_type", (F.col("event_id") % 101).alias("s"), "event_id",
    )


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply text per (user, reply): thinking, a fence, trailing commas; every third breaks off in its last item."""
    item = F.format_string('{"start": "%d", "end": %d, "type": "%s", "score": %d, "id": %d,}', "a", "b", "event_type", "s", "event_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", item.alias("item"))))
    rows = _item_rows(spark, sf_dir).groupBy("user_id", "reply").agg(F.transform(ordered, lambda x: x["item"]).alias("list"))
    body = F.concat(F.lit('<think>{"no": 1}</think>Sure.\n```json\n{"note": "a } b", "candidates": ['), F.array_join("list", ", "), F.lit(",]}\n```"))
    cut = F.expr("substring(body, 1, length(body) - 20)")
    return rows.withColumn("body", body).select(
        "user_id", "reply", F.lit(100).alias("window_first"), F.lit(400).alias("window_last"),
        F.when((F.col("user_id") + F.col("reply")) % 3 == 0, cut).otherwise(F.col("body")).alias("text"), F.size("list").alias("asked"),
    )


def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir).withColumn("object", replies.object_of(F.col("text")))
    return r.select("user_id", "reply", F.get_json_object("object", "$.note").alias("note"), F.size(F.from_json(F.get_json_object("object", "$.candidates"), f"array<{replies.ITEM}>")).alias("n"))


def reply_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir).withColumn("items", replies.items(F.col("text"), ["candidates"]))
    return r.select("user_id", "reply", F.size("items").alias("n"), replies.coverage(F.size("items"), F.col("asked"), 0.9).alias("status"))


def discovery_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = replies.discovery(_replies(spark, sf_dir), ["user_id", "reply"], KINDS)
    return d.select("user_id", "reply", "pos", "valid", "first", "last", "kind", millis(F.col("score")).alias("score_1e3"))


def scoring_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for ids that were asked for (those of even number), the last entry of an id counts."""
    each = _replies(spark, sf_dir).select("user_id", F.posexplode(replies.items(F.col("text"), ["candidates"])).alias("pos", "item"))
    rows = each.select("user_id", F.col("item")["id"].try_cast("long").alias("id"), ten(F.col("item")["score"]).alias("ten"))
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("id")).filter("id % 2 = 0")
    return replies.known_only(rows, asked, ["id"]).select("user_id", "id", millis(F.col("ten")).alias("ten_1e3"))


def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 7, "true").when(F.col("l_linenumber") == 6, " ").otherwise(F.col("l_quantity").cast("string"))
    return li.groupBy(text.alias("value")).agg(F.count("*").alias("n")).select(
        "value", "n", millis(unit(F.col("value"))).alias("unit_1e3"), millis(ten(F.col("value"))).alias("ten_1e3")
    )


def content_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5000).alias("bag"), "event_type")
    return replies.vote(e, "bag", "event_type", 0.6, "general")


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("got"), F.count_if(F.col("role") == "user").alias("expected")
    )
    return c.select("conv_id", "got", "expected", replies.coverage(F.col("got"), F.col("expected"), 0.7).alias("status"))


def role_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    category = F.when(F.col("event_id") % 3 == 0, "rate_limit").when(F.col("event_id") % 3 == 1, "timeout").otherwise("other")
    return s.select("user_id", F.col("event_id").alias("id"), F.col("start_s").alias("at_s"), (F.col("kind") == "error").alias("failed"), category.alias("category"))


def health_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.health(_log(spark, sf_dir), "user_id")


def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.call_stats(_log(spark, sf_dir), "user_id")


def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as models and nations as providers: those of two regions are configured."""
    s = table(spark, sf_dir, "supplier")
    models = s.select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("provider"),
        F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("score"), (F.col("s_suppkey") % 7).cast("int"))).otherwise(F.create_map(F.lit("judge"), F.lit(1))).alias("priority"),
    )
    configured = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("provider"))
    return routing.eligible(models, "score", configured)


def _chunks(bodies: DataFrame) -> DataFrame:
    """Bodies (doc_id, s) cut into pieces in one pass; a piece does not carry its body, and is not looked for from the body's beginning."""
    pieces = F.regexp_extract_all("s", F.lit(rf"(?s)(.{{1,{CHUNK}}})"), F.lit(1))
    return bodies.select("doc_id", F.posexplode_outer(pieces).alias("seq", "body")).filter("seq is not null")


def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents sent as a line protocol, cut into pieces anywhere, and read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("data: "), F.regexp_replace("text", "\n", "\r\n\r\ndata: "), F.lit("\n")).alias("s"))
    return wire.event_lines(_chunks(d), "doc_id").select("doc_id", "line", F.md5("payload").alias("digest"))


def sse_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streamed completions of nine words an event, with unreadable events, usage, an end mark and more after it, put together again."""
    d = word_lists(spark, sf_dir)
    said = lambda tokens, k: F.array_join(F.slice(tokens, k * EVENT_WORDS + 1, F.lit(EVENT_WORDS)), " ")
    starts = lambda tokens: F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / EVENT_WORDS).cast("int"))
    quoted = lambda text: F.regexp_extract(F.to_json(F.struct(text.alias("c"))), r"(?s)^\{\"c\":(.*)\}$", 1)
    content = lambda text: F.concat(F.lit('data: {"choices": [{"delta": {"content": '), quoted(text), F.lit("}}]}\r\n"))
    event = lambda tokens, k: F.concat(F.when(k % 4 == 2, "data: {broken\n: a remark\n").otherwise(""), content(said(tokens, k)))
    usage = F.concat(
        F.lit('data: {"choices": [{"delta": {}, "finish_reason": "'), F.when(F.col("doc_id") % 3 == 0, "length").otherwise("stop"),
        F.lit('"}], "usage": {"prompt_tokens": '), F.size("tokens").cast("string"), F.lit(', "completion_tokens": 7}}\n'),
    )
    # The tokens are bound once a row; a lambda over a column would split the text again for each event.
    events = let(F.col("tokens"), lambda tokens: F.transform(starts(tokens), lambda k: event(tokens, k)))
    body = F.concat(F.array_join(events, ""), usage, F.lit("data: [DONE]\n"), content(F.lit("too late")), F.lit("data: open"))
    lines = wire.event_lines(_chunks(d.select("doc_id", body.alias("s"))), "doc_id", complete=True)
    found = wire.deltas(wire.completion_events(lines, "doc_id"), "doc_id")
    return found.select("doc_id", F.md5("text").alias("digest"), "finish", F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"))


def multipart_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as one body with lengths; every fifth body is one character short."""
    c = table(spark, sf_dir, "conversations").filter("length(text) > 0")
    parts = c.select("conv_id", F.col("turn").alias("part"), F.length("text").cast("long").alias("length"))
    joined = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("b"))
    bodies = joined.select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.expr("substring(b, 2)")).otherwise(F.col("b")).alias("body"))
    return wire.framed(parts, bodies, "conv_id").select("conv_id", "part", F.md5("piece").alias("digest"), "ok")


def shot_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", "embedding")
    return series.cuts(frames, "clip", "vec_id", "embedding", 0.05, 1.0).select("clip", "vec_id")


def smooth_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = energy(spark, sf_dir).select("user_id", (F.col("frame") * FRAME_S).alias("t"), ((F.col("db") + 100) * 10).alias("v"), F.col("frame").cast("int").alias("i"))
    return series.smoothed(rows, ["user_id"]).select("user_id", "i", half_up(F.col("v"), 3).alias("v"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: two faces a frame that drift, in clips of 64 frames; every ninth clip has one face, and in some mouths are seen."""
    e = table(spark, sf_dir, "events").select("event_id")
    frame, clip = F.floor(F.col("event_id") / 2), F.floor(F.col("event_id") / 128)
    left = F.col("event_id") % 2 == 0
    rows = e.withColumn("clip", clip).withColumn("f", frame % 64).filter((F.col("event_id") % 2 == 0) | (clip % 9 != 0))
    x = F.when(left, 300 + F.col("f") % 7).otherwise(F.when(clip % 2 == 0, 1500).otherwise(500) + F.col("f") % 5)
    talks = left == (F.col("f") < 16)
    mouth = F.when(clip % 6 == 2, F.when(talks, (F.col("f") % 2) * 0.2).otherwise(0.1))
    one = lambda v: F.lit(v).cast("double")
    return rows.select(
        "clip", (F.col("f") / 3).alias("t"), x.cast("double").alias("x"), one(400).alias("y"), one(120).alias("w"), one(150).alias("h"), mouth.alias("mouth")
    )


def face_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layout.prominent(layout.tracks(_boxes(spark, sf_dir)))
    return p.select("clip", "track", "n", millis(F.col("span_s")).alias("span_ms"))


def _shots(boxes: DataFrame) -> DataFrame:
    """Pictures get bright after ten seconds, so that is a cut; for one frame later on they flicker, which is another."""
    frames = boxes.select("clip", "t").distinct()
    f = F.floor(F.col("t") * 3 + 0.5)
    light = F.when(f < 30, 20).when(f == 50, 120).otherwise(220) + f % 3
    pictures = frames.withColumn("picture", F.array(*(light.cast("double") for _ in range(4))))
    return layout.shots_of(pictures, boxes.groupBy("clip").agg((F.max("t") + 1 / 3).alias("duration_s")))


def layout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    p = layout.plan(layout.tracks(boxes), _shots(boxes), 1920, 1080)
    return p.select(
        "clip", "shot", millis(F.col("start")).alias("start_ms"), millis(F.col("end")).alias("end_ms"), "layout", "faces", "locked",
        millis(F.col("crop_x")).alias("crop_x_1e3"), millis(F.col("top.x")).alias("top_x_1e3"),
    )


def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots' layouts as segments that cover their clip."""
    boxes = _boxes(spark, sf_dir)
    p = layout.plan(layout.tracks(boxes), _shots(boxes), 1920, 1080)
    out = layout.tiled(p, boxes.groupBy("clip").agg((F.max("t") + 1 / 3).alias("duration_s")))
    return out.select("clip", "segment", millis(F.col("start")).alias("start_ms"), millis(F.col("end")).alias("end_ms"), "layout", "locked")


def speaker_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of shots that follow the speaker."""
    boxes = _boxes(spark, sf_dir)
    tracked, shots = layout.tracks(boxes), _shots(boxes)
    turns = layout.speaker_segments(tracked, layout.plan(tracked, shots, 1920, 1080), shots)
    return turns.select("clip", "shot", "turn", "track", millis(F.col("start")).alias("start_ms"), millis(F.col("end")).alias("end_ms"))


def crop_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames of the crops on the left faces, a segment of eight seconds each, drifting in half of the clips."""
    boxes = _boxes(spark, sf_dir).filter("x < 400")
    moved = boxes.withColumn("x", F.when(F.col("clip") % 2 == 0, F.col("x") + F.col("t") * 40).otherwise(F.col("x")))
    tracked = layout.tracks(moved)
    segments = tracked.groupBy("clip", "track").agg(F.max("t").alias("_end")).select(
        "clip", F.posexplode(F.sequence(F.lit(0), F.floor(F.col("_end") / 8).cast("int"))).alias("segment", "k"), "track"
    ).select("clip", "segment", "track", (F.col("k") * 8.0).alias("start"), (F.col("k") * 8.0 + 8).alias("end"))
    k = layout.keyframes(tracked, segments, 1920, 1080)
    return k.groupBy("clip", "segment").agg(F.count("*").alias("frames"), millis(F.min("x")).alias("least_x_1e3"), millis(F.max("x")).alias("most_x_1e3"))


def crop_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_size") * 40 + 100).alias("w"), (F.col("p_size") * 7 % 50 * 20 + 200).alias("h")).distinct()
    w, h = crop_size(F.col("w"), F.col("h"), 9, 16)
    return p.select("w", "h", w.alias("crop_w"), h.alias("crop_h"))


def recent_taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the newest event of every value class, then the six newest a type."""
    s = spans(spark, sf_dir).withColumn("title", F.floor("score")).withColumn("at", F.struct("start_s", "event_id"))
    last = store.latest(s, ["user_id", "title"], "at")
    return store.latest(last, ["user_id", "kind"], "at", 6).select("user_id", "kind", "event_id")


def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return store.latest(o, ["o_custkey"], "at").select("o_custkey", "o_orderkey", slug(F.col("o_orderpriority")).alias("name"))


def pending_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a returned line: what an incremental run would still have to make."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def turn_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of neighbouring turns of a conversation by content words."""
    c = table(spark, sf_dir, "conversations").withColumn("ws", content_words(F.col("text")))
    w = F.lag("ws").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", millis(jaccard(F.col("ws"), w)).alias("likeness_1e3"))


_ITEMS = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
rows_ AS (
  SELECT user_id, CAST(frame // {PER_REPLY} AS INT) AS reply, frame % {PER_REPLY} AS pos, event_id % 450 AS a,
    event_id % 450 + event_id % 60 - 5 AS b, event_type, event_id % 101 AS s, event_id FROM numbered
), sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, reply) AS asked FROM rows_
), kept AS (SELECT * FROM sized WHERE (user_id + reply) % 3 <> 0 OR pos < asked - 1)"""
_UNIT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {0} > 10 THEN {0} / 100.0::DOUBLE WHEN {0} > 1 THEN {0} / 10.0::DOUBLE ELSE {0} END))"
_TEN = "greatest(0.0::DOUBLE, least(10.0::DOUBLE, CASE WHEN {0} > 10 THEN {0} / 10.0::DOUBLE WHEN {0} > 0 AND {0} <= 1 AND {0} <> floor({0}) THEN {0} * 10 ELSE {0} END))"
_K = "CAST(floor(({0}) * 1000 + 0.5) AS BIGINT)"

_ALPHA = "(1 / (1 + 1 / (2 * pi() * {0}) / dt))"
_BOXES = """b AS (SELECT event_id // 128 AS clip, event_id // 2 % 64 AS f, event_id % 2 AS side, event_id // 2 % 64 / 3 AS t,
          CASE WHEN event_id % 2 = 0 THEN 300 + event_id // 2 % 64 % 7 WHEN event_id // 128 % 2 = 0 THEN 1500 + event_id // 2 % 64 % 5 ELSE 500 + event_id // 2 % 64 % 5 END AS x
          FROM events WHERE event_id % 2 = 0 OR event_id // 128 % 9 <> 0
        ), named AS (SELECT clip, side, row_number() OVER (PARTITION BY clip ORDER BY min(f), side) - 1 AS track FROM b GROUP BY clip, side)"""
_SHOTS = """edges AS (
          SELECT clip, max(f) AS top, (max(f) + 1) / 3 AS d FROM b GROUP BY clip
        ), shots AS (
          SELECT clip, 0 AS shot, 0.0::DOUBLE AS s, CASE WHEN top >= 30 THEN 59 / 6 ELSE d END AS e FROM edges
          UNION ALL SELECT clip, 1, 59 / 6, CASE WHEN top >= 50 AND d - 99 / 6 >= 0.8 THEN 99 / 6 ELSE d END FROM edges WHERE top >= 30
          UNION ALL SELECT clip, 2, 99 / 6, d FROM edges WHERE top >= 50 AND d - 99 / 6 >= 0.8
        )"""

_LAYOUTS = f"""{_BOXES}, {_SHOTS}, sampled AS (
          SELECT s.clip, shot, s, e, greatest(1, count(DISTINCT f)) AS samples FROM shots s LEFT JOIN b ON b.clip = s.clip AND t >= s AND t < e GROUP BY ALL
        ), people AS (
          SELECT p.clip, shot, side, s, e, count(*) AS n, avg(x + 60) AS mx, min(x) AS l, max(x + 120) AS r, max(x) - min(x) AS spread
          FROM sampled p JOIN b ON b.clip = p.clip AND t >= s AND t < e GROUP BY p.clip, shot, side, s, e, samples HAVING count(*) >= greatest(2, samples * 0.25)
        ), sh AS (
          SELECT clip, shot, count(*) AS faces, min(l) AS l, max(r) AS r, min(mx) AS low, min(spread) AS spread, min(n) AS n, max(n) AS most FROM people GROUP BY ALL
        ), lay AS (
          SELECT p.clip, p.shot, s, e, coalesce(faces, 0) AS faces, l, r, low, spread, n, CASE WHEN faces IS NULL THEN 'centre' WHEN faces = 1 THEN 'face' WHEN r - l <= 608 * 0.95::DOUBLE THEN 'together'
            WHEN p.clip % 6 = 2 AND n >= 3 THEN 'speaker' ELSE 'stack' END AS layout FROM sampled p LEFT JOIN sh USING (clip, shot))"""

QUERIES = {
    "reply_objects": (
        reply_objects,
        f"""WITH {_ITEMS} SELECT user_id, reply, CASE WHEN (user_id + reply) % 3 <> 0 THEN 'a }} b' ELSE NULL END AS note,
          CAST(CASE WHEN (user_id + reply) % 3 <> 0 THEN count(*) END AS INT) AS n FROM sized GROUP BY user_id, reply""",
    ),
    "reply_salvage": (
        reply_salvage,
        f"""WITH {_ITEMS}, g AS (SELECT user_id, reply, max(asked) AS asked, count(*) FILTER (WHERE (user_id + reply) % 3 <> 0 OR pos < asked - 1) AS n
          FROM sized GROUP BY user_id, reply)
        SELECT user_id, reply, CASE WHEN n > 0 THEN n END AS n, CASE WHEN n = 0 THEN 'schema' WHEN n / asked < 0.9 THEN 'incomplete' ELSE 'ok' END AS status FROM g""",
    ),
    "discovery_contract": (
        discovery_contract,
        f"""WITH {_ITEMS}, v AS (SELECT *, a <= 400 AND b >= 100 AND a < b AS valid FROM kept)
        SELECT user_id, reply, pos, valid, CASE WHEN valid THEN greatest(100, least(400, a)) END AS first, CASE WHEN valid THEN greatest(100, least(400, b)) END AS last,
          CASE WHEN event_type IN ('view', 'click', 'signup') THEN event_type ELSE 'other' END AS kind, {_K.format(_UNIT.format('s'))} AS score_1e3 FROM v""",
    ),
    "scoring_contract": (
        scoring_contract,
        f"WITH {_ITEMS} SELECT user_id, event_id AS id, {_K.format(_TEN.format('s'))} AS ten_1e3 FROM kept WHERE event_id % 2 = 0",
    ),
    "unit_scale": (
        unit_scale,
        f"""WITH t AS (SELECT CASE l_linenumber WHEN 7 THEN 'true' WHEN 6 THEN ' ' ELSE CAST(l_quantity AS VARCHAR) END AS value, count(*) AS n FROM lineitem GROUP BY 1),
        x AS (SELECT *, CASE WHEN value = ' ' THEN 0 ELSE TRY_CAST(value AS DOUBLE) END AS v FROM t)
        SELECT value, n, CASE WHEN value = 'true' THEN 1000 ELSE {_K.format(_UNIT.format('v'))} END AS unit_1e3,
          CASE WHEN value <> 'true' THEN {_K.format(_TEN.format('v'))} END AS ten_1e3 FROM x""",
    ),
    "content_vote": (
        content_vote,
        """WITH c AS (SELECT event_id % 5000 AS bag, event_type, count(*) AS c FROM events GROUP BY ALL),
        r AS (SELECT *, sum(c) OVER (PARTITION BY bag) AS n, row_number() OVER (PARTITION BY bag ORDER BY c DESC, event_type DESC) AS r FROM c)
        SELECT bag, CASE WHEN c >= 0.6 * n THEN event_type ELSE 'general' END AS winner, CAST(n AS BIGINT) AS n FROM r WHERE r = 1""",
    ),
    "coverage_check": (
        coverage_check,
        """WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS got, count(*) FILTER (WHERE role = 'user') AS expected FROM conversations GROUP BY 1)
        SELECT *, CASE WHEN expected = 0 THEN 'ok' WHEN got = 0 THEN 'schema' WHEN got / expected < 0.7 THEN 'incomplete' ELSE 'ok' END AS status FROM c""",
    ),
    "role_turns": (
        role_turns,
        """WITH m AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM m)
        SELECT conv_id, run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run, role""",
    ),
    "health_timeline": (
        health_timeline,
        f"""WITH {SPANS_SQL}, l AS (
          SELECT user_id, event_id AS id, start_s AS at_s, kind = 'error' AS failed, CASE WHEN kind = 'error' THEN start_s + CASE event_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 240 ELSE 45 END ELSE 0 END AS until FROM spans)
        SELECT user_id, id, at_s >= coalesce(lag(until) OVER w, 0) AS usable, coalesce(sum(CAST(failed AS INT)) OVER b, 0) AS failures,
          coalesce(sum(CAST(NOT failed AS INT)) OVER b, 0) AS successes
        FROM l WINDOW w AS (PARTITION BY user_id ORDER BY at_s, id), b AS (PARTITION BY user_id ORDER BY at_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    "call_stats": (
        call_stats,
        f"""WITH {SPANS_SQL} SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE kind = 'error') AS failures,
          arg_max(event_id, (start_s, event_id)) FILTER (WHERE kind <> 'error') AS last_ok FROM spans GROUP BY user_id""",
    ),
    "model_route": (
        model_route,
        """SELECT s_suppkey AS id, s_nationkey AS provider, CAST(s_suppkey % 7 AS INT) AS place FROM supplier
        WHERE s_suppkey % 2 = 0 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)""",
    ),
    "sse_lines": (
        sse_lines,
        "SELECT doc_id, i - 1 AS line, md5(trim(l[i])) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)",
    ),
    "sse_deltas": (
        sse_deltas,
        f"""WITH {WORDS_SQL}, e AS (SELECT doc_id, idx // {EVENT_WORDS} AS k, string_agg(text, ' ' ORDER BY idx) AS t, max(n) AS n FROM tw GROUP BY ALL)
        SELECT doc_id, md5(string_agg(t, '' ORDER BY k)) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish, max(n)::BIGINT AS prompt_tokens, 7::BIGINT AS completion_tokens
        FROM e GROUP BY doc_id""",
    ),
    "multipart_frames": (
        multipart_frames,
        """SELECT conv_id, turn AS part, CASE WHEN conv_id % 5 <> 0 THEN md5(text) END AS digest, conv_id % 5 <> 0 AS ok FROM conversations WHERE length(text) > 0""",
    ),
    "shot_cuts": (
        shot_cuts,
        """WITH d AS (SELECT label AS clip, vec_id, embedding AS e, lag(embedding) OVER w AS p FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
        x AS (SELECT clip, vec_id, list_sum(list_transform(list_zip(e, p), lambda z: CAST(abs(z[1] - z[2]) AS DOUBLE))) / len(e) AS diff FROM d),
        y AS (SELECT *, coalesce(lag(diff) OVER (PARTITION BY clip ORDER BY vec_id), 0) AS before FROM x)
        SELECT clip, vec_id FROM y WHERE diff >= 0.05 AND diff > before * 2.5""",
    ),
    "smooth_series": (
        smooth_series,
        f"""WITH RECURSIVE {ENERGY_SQL}, r AS (SELECT user_id, frame, frame * {FRAME_S}::DOUBLE AS t, (db + 100) * 10 AS v FROM energy), sm AS (
          SELECT user_id, frame, t, v AS raw, v AS value, NULL::DOUBLE AS slope, v AS held FROM r WHERE frame = 0
          UNION ALL
          SELECT user_id, frame, t, v, value, slope, CASE WHEN abs(value - held) >= 12 THEN held + sign(value - held) * least(abs(value - held), 260 * greatest(1e-6, dt)) ELSE held END
          FROM (SELECT *, {_ALPHA.format('(0.6::DOUBLE + 0.02::DOUBLE * abs(slope))')} * v + (1 - {_ALPHA.format('(0.6::DOUBLE + 0.02::DOUBLE * abs(slope))')}) * old AS value
            FROM (SELECT user_id, frame, t, v, dt, old, held, CASE WHEN sl IS NULL THEN (v - raw) / dt ELSE {_ALPHA.format('1.0::DOUBLE')} * ((v - raw) / dt) + (1 - {_ALPHA.format('1.0::DOUBLE')}) * sl END AS slope
              FROM (SELECT r.user_id, r.frame, r.t, r.v, r.t - sm.t AS dt, sm.value AS old, sm.held, sm.slope AS sl, sm.raw FROM sm JOIN r ON r.user_id = sm.user_id AND r.frame = sm.frame + 1)))
        ) SELECT user_id, CAST(frame AS INT) AS i, floor(held * 1000 + 0.5) / 1000 AS v FROM sm""",
    ),
    "face_tracks": (
        face_tracks,
        f"""WITH {_BOXES} SELECT clip, track, count(*) AS n, CAST(floor((max(f) - min(f)) / 3 * 1000 + 0.5) AS BIGINT) AS span_ms
        FROM b JOIN named USING (clip, side) GROUP BY clip, track HAVING max(f) - min(f) >= 1.5 OR count(*) >= 3""",
    ),
    "layout_plan": (
        layout_plan,
        f"""WITH {_LAYOUTS}
        SELECT clip, shot, {_K.format('s')} AS start_ms, {_K.format('e')} AS end_ms, layout, faces,
          CASE layout WHEN 'face' THEN spread < 12 OR n < 3 WHEN 'stack' THEN false WHEN 'speaker' THEN false ELSE true END AS locked,
          {_K.format("CASE layout WHEN 'centre' THEN (1920 - 608) / 2 WHEN 'face' THEN greatest(0, least(1920 - 608, low - 304)) WHEN 'together' THEN greatest(0, least(1920 - 608, (l + r) / 2 - 304)) END")} AS crop_x_1e3,
          {_K.format("CASE WHEN layout = 'stack' THEN greatest(0, least(1920 - 384, low - 192)) END")} AS top_x_1e3 FROM lay""",
    ),
    "layout_segments": (
        layout_segments,
        f"""WITH RECURSIVE {_LAYOUTS}, x AS (
          SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY s) AS k, s, e, layout, CASE layout WHEN 'face' THEN spread < 12 OR n < 3 WHEN 'stack' THEN false WHEN 'speaker' THEN false ELSE true END AS locked,
            CASE layout WHEN 'centre' THEN (1920 - 608) / 2 WHEN 'face' THEN greatest(0, least(1920 - 608, low - 304)) WHEN 'together' THEN greatest(0, least(1920 - 608, (l + r) / 2 - 304)) END AS cx
          FROM lay WHERE e - s > 0.01::DOUBLE
        ), m AS (
          SELECT clip, k, [{{'s': s, 'layout': layout, 'locked': locked, 'cx': cx}}] AS kept FROM x WHERE k = 1
          UNION ALL
          SELECT m.clip, x.k, CASE WHEN coalesce(kept[-1].locked AND x.locked AND abs(kept[-1].cx - x.cx) < 12, false) THEN kept
            ELSE list_append(kept, {{'s': x.s, 'layout': x.layout, 'locked': x.locked, 'cx': x.cx}}) END FROM m JOIN x ON x.clip = m.clip AND x.k = m.k + 1
        ), o AS (SELECT clip, kept FROM m QUALIFY k = max(k) OVER (PARTITION BY clip)
        ), g AS (SELECT clip, i, kept[i] AS p, kept[i + 1].s AS nxt FROM o, unnest(range(1, len(kept) + 1)) AS r(i))
        SELECT clip, i - 1 AS segment, CASE WHEN i = 1 THEN 0 ELSE {_K.format('p.s')} END AS start_ms, {_K.format('coalesce(nxt, d)')} AS end_ms, p.layout AS layout, p.locked AS locked
        FROM g JOIN edges USING (clip)""",
    ),
    "speaker_layout": (speaker_layout, None),
    "crop_keyframes": (crop_keyframes, None),
    "crop_sizes": (
        crop_sizes,
        """WITH p AS (SELECT DISTINCT p_size * 40 + 100 AS w, p_size * 7 % 50 * 20 + 200 AS h FROM part),
        c AS (SELECT *, CAST(floor(h * 9 / 16 + 0.5) AS INT) AS wide FROM p)
        SELECT w, h, least(wide, w) // 2 * 2 AS crop_w, CASE WHEN wide <= w THEN h ELSE CAST(floor(w * 16 / 9 + 0.5) AS INT) END // 2 * 2 AS crop_h FROM c""",
    ),
    "recent_taste": (
        recent_taste,
        f"""WITH {SPANS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, floor(score) ORDER BY start_s DESC, event_id DESC) AS r FROM spans),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY start_s DESC, event_id DESC) AS q FROM l WHERE r = 1)
        SELECT user_id, kind, event_id FROM k WHERE q <= 6""",
    ),
    "job_latest": (
        job_latest,
        """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
        SELECT o_custkey, o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS name FROM o WHERE r = 1""",
    ),
    "pending_clips": (
        pending_clips,
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    ),
    "turn_likeness": (
        turn_likeness,
        f"""WITH c AS (SELECT conv_id, turn, {_CONTENT} AS ws FROM conversations),
        p AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM c)
        SELECT conv_id, turn, CASE WHEN q IS NULL THEN NULL WHEN len(ws) = 0 OR len(q) = 0 THEN 0
          ELSE {_K.format("len(list_intersect(ws, q)) / len(list_distinct(list_concat(ws, q)))")} END AS likeness_1e3 FROM p""",
    ),
}
