"""Queries over replies of a speech service, staged jobs and render plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.numbers import let, millis
from quillspan.functions.text import tokens as tokens_of
from quillspan.sources import recognition, stages, store
from quillspan.sources.adapters import WORDS_SQL, table

#: Words of a result, and of how many results one has no alternative, of how many words one is blank.
RESULT_WORDS, NONE_OF, BLANK_OF = 12, 5, 17


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as replies: results of twelve words and a second alternative that says otherwise; every fifth result is empty."""
    def word(w, at):
        begin = F.when(at > 0, at * 400)
        return F.struct(F.when(at % BLANK_OF == BLANK_OF - 1, "  ").otherwise(F.concat(F.lit(" "), w)).alias("word"), begin.alias("start_time"), (at * 400 + 300).alias("end_time"))

    def result(tokens, r):
        said = F.slice(tokens, r * RESULT_WORDS + 1, F.lit(RESULT_WORDS))
        first = F.struct(F.concat(F.lit("\n "), F.array_join(said, " "), F.lit("  ")).alias("transcript"), F.transform(said, lambda w, i: word(w, r * RESULT_WORDS + i)).alias("words"))
        other = F.struct(F.lit("something else").alias("transcript"), F.transform(F.slice(said, 1, 1), lambda w: word(F.lit("else"), F.lit(1))).alias("words"))
        return F.struct(F.when(r % NONE_OF == NONE_OF - 2, F.slice(F.array(first, other), 1, 0)).otherwise(F.array(first, other)).alias("alternatives"))

    # The tokens are bound once a row; a lambda over a column would split the text again for each result.
    starts = lambda tokens: F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / RESULT_WORDS).cast("int"))
    results = let(F.col("tokens"), lambda tokens: F.transform(starts(tokens), lambda r: result(tokens, r)))
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens_of(F.col("text")).alias("tokens"))
    # Documents without words are replies without results.
    return docs.select("doc_id", F.when(F.size("tokens") > 0, F.to_json(F.struct(results.alias("results")))).otherwise("{}").alias("reply"))


def speech_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognition.recognised_words(_replies(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "idx", "result", "text", millis(F.col("start_s")).alias("start_ms"), millis(F.col("end_s")).alias("end_ms"))


def speech_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as parts, also those in which nothing was heard."""
    return recognition.recognised(_replies(spark, sf_dir), ["doc_id"]).select("doc_id", F.size("words").alias("words"), F.md5("text").alias("digest"))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter("text != ''")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as jobs of two stages: those in English come first, then all of them, some with a changed text; jobs of one source are removed."""
    home = f"{store.folder(spark)}/quillspan-stages-{uuid.uuid4().hex}"
    steps = [stages.Stage("lines", _lines), stages.Stage("sizes", _sizes)]
    jobs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("job_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    changed = F.when(F.length("text") % 2 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    stages.run(jobs.filter("lang = 'en'").select("job_id", changed.alias("text")), steps, home)
    stages.run(jobs.select("job_id", "text"), steps, home)
    stages.remove(spark, home, "src1/")
    return stages.artifact(spark, home, "sizes")


QUERIES = {
    "speech_replies": (
        speech_replies,
        f"""WITH {WORDS_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INT) AS idx, CAST(idx // {RESULT_WORDS} AS INT) AS result, text,
          idx * 400 AS start_ms, idx * 400 + 300 AS end_ms FROM tw WHERE idx // {RESULT_WORDS} % {NONE_OF} <> {NONE_OF - 2} AND idx % {BLANK_OF} <> {BLANK_OF - 1}""",
    ),
    "speech_parts": (
        speech_parts,
        f"""WITH {WORDS_SQL}, k AS (SELECT doc_id, idx, text FROM tw WHERE idx // {RESULT_WORDS} % {NONE_OF} <> {NONE_OF - 2}),
        s AS (SELECT doc_id, count(*) FILTER (WHERE idx % {BLANK_OF} <> {BLANK_OF - 1}) AS n, string_agg(text, ' ' ORDER BY idx) AS t FROM k GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS words, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN s USING (doc_id)""",
    ),
    "resumed_stages": (
        resumed_stages,
        """SELECT source || '/' || doc_id AS job_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
        FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE line <> '' AND NOT starts_with(source || '/', 'src1/') GROUP BY ALL""",
    ),
}
