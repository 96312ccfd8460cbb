"""Queries over review screens: runners-up, prominence, progress, positions, batches, pair answers, wrapped lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.numbers import half_up, millis
from quillspan.functions.text import tokens
from quillspan.operators import review
from quillspan.plans.transcripts import ms
from quillspan.sources.adapters import SPANS_SQL, spans, table

#: Events as steps of a job.
STAGE_OF = {"view": "prepare", "click": "listen", "signup": "choose", "purchase": "make"}
WIDTH = 32


def runner_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review.runners_up(spans(spark, sf_dir), "user_id", "event_id", 3, 12)
    return ms(r.select("user_id", "event_id", "start_s", "end_s", F.col("place").cast("long").alias("place")), "start_s", "end_s")


def track_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and kind as one track; the value is the box's width and height."""
    s = spans(spark, sf_dir)
    seen = s.select("user_id", "kind", F.col("start_s").alias("t"), F.floor(F.col("score")).alias("w"), F.floor(F.col("score")).alias("h"))
    p = review.prominence(seen, ["user_id", "kind"])
    return p.select("user_id", "kind", "n", millis(F.col("span_s")).alias("span_ms"), half_up(F.col("area")).cast("long").alias("area"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    stage = F.lit(None).cast("string")
    for event, name in STAGE_OF.items():
        stage = F.when(kind == event, name).otherwise(stage)
    marks = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", stage.alias("stage"), (F.col("value") / 80).alias("fraction"), "value")
    p = review.progress(marks, "user_id", ["ts", "event_id"])
    left = review.seconds_left(F.col("value"), F.col("progress") - 0.1, F.col("progress"))
    return p.select("event_id", "stage", half_up(F.col("progress") * 10_000).cast("long").alias("progress_1e4"), millis(left).alias("left_ms"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as keyframes of a user; every other event reads its position from them."""
    s = spans(spark, sf_dir).withColumn("t", F.col("start_s"))
    frames = s.filter("kind = 'view'").select("user_id", "t", F.col("score").alias("x"))
    points = s.filter("kind != 'view'").select("user_id", "t", "event_id")
    return review.position_at(points, frames, ["user_id"]).select("event_id", half_up(F.col("x") * 100).cast("long").alias("x_100"))


def turn_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in batches of six, with the range and size of each."""
    c = review.batches(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], 6)
    return c.groupBy("conv_id", "batch").agg(
        F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars")
    )


def pair_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a part and a supplier asked by orders of over 45 pieces, answered by those of under 5 in either orientation."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("q"))
    asked = items.filter("q > 45").select("a", "b").distinct()
    answers = items.filter("q < 5").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = review.symmetric(asked, answers, "a", "b")
    return both.groupBy("a", "b").agg(F.sum("n").alias("answers"))


def next_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each job (customer): finished and pending clips (orders), and the rank of the next one."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg(
        F.count_if(status == "F").alias("ready"), F.count_if(status != "F").alias("pending"), (F.max("o_orderkey") + 1).alias("next_rank")
    )


def gaps_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a user's timeline as consecutive pairs."""
    from pyspark.sql import Window

    edges = spans(spark, sf_dir).select("user_id", F.explode(F.array("start_s", "end_s")).alias("edge")).distinct()
    pairs = edges.withColumn("to_s", F.lead("edge").over(Window.partitionBy("user_id").orderBy("edge"))).filter("to_s is not null")
    return ms(pairs.select("user_id", F.col("edge").alias("from_s"), "to_s"), "from_s", "to_s")


def wrapped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of at most 32 characters."""
    lines = review.wrapped(tokens(F.coalesce(F.col("text"), F.lit(""))), WIDTH)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.alias("lines"))
    return c.select("conv_id", "turn", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


QUERIES = {
    "runner_ups": (
        runner_ups,
        f"""WITH {SPANS_SQL}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, start_s, event_id) AS k FROM spans
        ), free AS (
          SELECT * FROM ranked r WHERE k > 3 AND NOT EXISTS (
            SELECT 1 FROM ranked p WHERE p.user_id = r.user_id AND p.k <= 3 AND least(p.end_s - p.start_s, r.end_s - r.start_s) > 0
              AND greatest(0, least(p.end_s, r.end_s) - greatest(p.start_s, r.start_s)) / least(p.end_s - p.start_s, r.end_s - r.start_s) > 0.15::DOUBLE)
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, start_s, event_id) AS place FROM free)
        SELECT user_id, event_id, CAST(floor(start_s * 1000 + 0.5::DOUBLE) AS BIGINT) AS start_ms,
          CAST(floor(end_s * 1000 + 0.5::DOUBLE) AS BIGINT) AS end_ms, place FROM placed WHERE place <= 12""",
    ),
    "track_prominence": (
        track_prominence,
        f"""WITH {SPANS_SQL} SELECT user_id, kind, count(*) AS n, CAST(floor((max(start_s) - min(start_s)) * 1000 + 0.5::DOUBLE) AS BIGINT) AS span_ms,
          CAST(floor(avg(floor(score) * floor(score)) + 0.5::DOUBLE) AS BIGINT) AS area
        FROM spans GROUP BY user_id, kind HAVING max(start_s) - min(start_s) >= 0.5 OR count(*) >= 3""",
    ),
    "job_progress": (
        job_progress,
        """WITH m AS (
          SELECT event_id, user_id, ts, value, least(greatest(value / 80::DOUBLE, 0), 1) AS f,
            CASE event_type WHEN 'view' THEN 'prepare' WHEN 'click' THEN 'listen' WHEN 'signup' THEN 'choose' WHEN 'purchase' THEN 'make' END AS stage FROM events
        ), o AS (
          SELECT *, CASE stage WHEN 'prepare' THEN 0::DOUBLE + 0.12::DOUBLE * f WHEN 'listen' THEN 0.12::DOUBLE + (0.35::DOUBLE - 0.12::DOUBLE) * f
            WHEN 'choose' THEN 0.35::DOUBLE + (0.55::DOUBLE - 0.35::DOUBLE) * f WHEN 'make' THEN 0.55::DOUBLE + (1::DOUBLE - 0.55::DOUBLE) * f END AS whole FROM m
        ), p AS (
          SELECT *, coalesce(greatest(0, max(whole) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 0) AS progress FROM o
        )
        SELECT event_id, stage, CAST(floor(progress * 10000 + 0.5::DOUBLE) AS BIGINT) AS progress_1e4,
          CASE WHEN progress - 0.1::DOUBLE >= 0.03::DOUBLE AND value >= 20
            THEN CAST(floor(greatest(60::DOUBLE, value / (progress - 0.1::DOUBLE) * (1 - progress)) * 1000 + 0.5::DOUBLE) AS BIGINT) END AS left_ms FROM p""",
    ),
    "positions": (
        positions,
        f"""WITH {SPANS_SQL}, k AS (SELECT user_id, start_s AS t, max(score) AS x FROM spans WHERE kind = 'view' GROUP BY ALL
        ), q AS (SELECT user_id, event_id, start_s AS t FROM spans WHERE kind <> 'view'
        ), a AS (SELECT q.event_id, max(k.t) AS ka, arg_max(k.x, k.t) AS ax FROM q JOIN k ON k.user_id = q.user_id AND k.t <= q.t GROUP BY q.event_id
        ), b AS (SELECT q.event_id, min(k.t) AS kb, arg_min(k.x, k.t) AS bx FROM q JOIN k ON k.user_id = q.user_id AND k.t >= q.t GROUP BY q.event_id
        )
        SELECT event_id, CAST(floor(100 * CASE WHEN ka IS NULL AND kb IS NULL THEN 0 WHEN ka IS NULL THEN bx WHEN kb IS NULL THEN ax
          WHEN kb > ka THEN ax + (bx - ax) * ((t - ka) / (kb - ka)) ELSE bx END + 0.5::DOUBLE) AS BIGINT) AS x_100
        FROM q LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""",
    ),
    "turn_batches": (
        turn_batches,
        """SELECT conv_id, (k - 1) // 6 AS batch, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn,
          CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY ALL""",
    ),
    "pair_answers": (
        pair_answers,
        """WITH asked AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 45
        ), answers AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem WHERE l_quantity < 5 GROUP BY ALL)
        SELECT x.a, x.b, CAST(sum(y.n) AS BIGINT) AS answers FROM asked x JOIN answers y
          ON least(x.a, x.b) = least(y.a, y.b) AND greatest(x.a, x.b) = greatest(y.a, y.b) GROUP BY x.a, x.b""",
    ),
    "next_ranks": (
        next_ranks,
        """SELECT o_custkey AS job, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus <> 'F') AS pending,
          max(o_orderkey) + 1 AS next_rank FROM orders GROUP BY o_custkey""",
    ),
    "gaps_between": (
        gaps_between,
        f"""WITH {SPANS_SQL}, e AS (SELECT user_id, start_s AS edge FROM spans UNION SELECT user_id, end_s FROM spans
        ), p AS (SELECT user_id, edge, lead(edge) OVER (PARTITION BY user_id ORDER BY edge) AS till FROM e)
        SELECT user_id, CAST(floor(edge * 1000 + 0.5::DOUBLE) AS BIGINT) AS from_ms, CAST(floor(till * 1000 + 0.5::DOUBLE) AS BIGINT) AS to_ms
        FROM p WHERE till IS NOT NULL""",
    ),
    "wrapped_turns": (
        wrapped_turns,
        f"""WITH RECURSIVE c AS (
          SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS ws FROM conversations
        ), w AS MATERIALIZED (SELECT conv_id, turn, k, ws[k] AS word FROM c, unnest(range(1, len(ws) + 1)) AS t(k)
        ), l AS (
          SELECT conv_id, turn, k, 1 AS line, length(word) AS used FROM w WHERE k = 1
          UNION ALL SELECT w.conv_id, w.turn, w.k, CASE WHEN used + 1 + length(word) <= {WIDTH} THEN line ELSE line + 1 END,
            CASE WHEN used + 1 + length(word) <= {WIDTH} THEN used + 1 + length(word) ELSE length(word) END
          FROM l JOIN w ON w.conv_id = l.conv_id AND w.turn = l.turn AND w.k = l.k + 1
        ), s AS (SELECT conv_id, turn, line, string_agg(word, ' ' ORDER BY k) AS text FROM l JOIN w USING (conv_id, turn, k) GROUP BY ALL
        ), j AS (SELECT conv_id, turn, count(*) AS n, string_agg(text, chr(10) ORDER BY line) AS text FROM s GROUP BY ALL)
        SELECT conv_id, turn, coalesce(n, 0) AS n_lines, coalesce(j.text, '') AS text FROM c LEFT JOIN j USING (conv_id, turn)""",
    ),
}
