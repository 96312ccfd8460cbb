"""Chat formatting (operator 4): prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the text of all turns up to it, of which only that
reply is trainable (``loss_start``, ``loss_chars``, in code points). A conversation that does not end
with an assistant turn gets one more example without a trainable part, so that no turn is lost.

Template, per turn: ``<s>`` role newline text ``</s>`` newline. Control strings inside a text (see
``CONTROL``) get a backslash after their first character, after any that are there already, which is
undone exactly when reading back. In a role, ``&`` and newlines are written as character references.

Scale: one shuffle, by conversation; a row holds one conversation, as its examples must. The expanded
texts are never shuffled: reading them back groups by the same key.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a
fixed order and are kept; a null role or text counts as empty; a null conv_id is a conversation of its
own; extra columns play no part; no rows give no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings that chat tokenizers of this family read as control tokens.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE = "<s>", "</s>\n"
_REST = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_REST}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_REST}", "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("&#10;")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_turns (context and target), text, trainable, loss_start, loss_chars."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    heads = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    written = heads.select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))).alias("parts"),
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.size("turns")),
        ).alias("ends"),
    )
    each = written.select("conv_id", "turns", "parts", F.posexplode("ends").alias("example", "n_turns"))
    last = F.element_at("turns", F.col("n_turns"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("n_turns") - 1), "")
    trainable = last["role"] == "assistant"
    return each.select(
        "conv_id",
        "example",
        "n_turns",
        context.alias("context"),
        F.concat(last["head"], last["body"], F.lit(CLOSE)).alias("reply"),
        trainable.alias("trainable"),
        F.length(last["head"]).alias("head_chars"),
        F.when(trainable, F.length(last["body"])).otherwise(0).alias("loss_chars"),
    ).select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("context", "reply").alias("text"),
        "trainable",
        (F.length("context") + F.col("head_chars")).alias("loss_start"),
        "loss_chars",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: turns, trainable text and sizes."""
    loss = unescape(F.expr("substring(text, loss_start + 1, loss_chars)"))
    whole = formatted.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    pieces = F.filter(F.split("whole", CLOSE), lambda p: p != "")
    role = lambda p: F.substring_index(p, "\n", 1)
    read = F.transform(
        pieces,
        lambda p: F.concat(
            unescape_role(F.replace(role(p), F.lit(OPEN))),
            F.lit("\n"),
            unescape(F.substr(p, F.length(role(p)) + 2)),
            F.lit("\n"),
        ),
    )
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(read, ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings in a user's and an assistant's turn."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe(spark))
    return read_back(examples(rows))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(role, '&', '&amp;'), chr(10), '&#10;'))
      + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) + 9 AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), upto AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id
"""
