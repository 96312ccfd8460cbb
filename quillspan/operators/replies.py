"""Model replies: first object, salvage of cut-off lists, and what a list of items must keep to.

Finding an object needs a scan that knows strings and escapes; that is one small Arrow function, which reads a reply once
and salvages only where the object lacks its list. All else is column expressions over maps of strings, so that odd
types in a reply never fail a query.

Deviations: reasoning blocks may also be tagged ``thinking``; trailing commas are forgiven in salvaged items too, and a comma
inside a string stays unless the object is unreadable without the repair.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp, unit, whole
from quillspan.functions.text import strip_reasoning
from quillspan.session import importable

ITEM = "map<string,string>"
PARSED = "struct<content_type: string, items: array<string>>"
#: Rows that are Python objects at once.
ROWS = 64
_MARK = re.compile(r'["{}]')
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_TRAILING = re.compile(r",\s*([}\]])")


def _balanced_end(text: str, begin: int) -> int:
    """The place of the brace that closes the one at ``begin``, or -1."""
    depth, at = 0, begin
    while m := _MARK.search(text, at):
        at = m.end()
        if m[0] == '"':
            quoted = _QUOTED.match(text, m.start())
            if not quoted:
                return -1
            at = quoted.end()
        else:
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.start()
    return -1


def _no_constant(name: str):
    raise ValueError(name)


def _parsed(part: str) -> dict | None:
    """A JSON object; where that is unreadable, without its trailing commas."""
    for repair in (False, True):
        try:
            found = json.loads(_TRAILING.sub(r"\1", part) if repair else part, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            continue
        return found if isinstance(found, dict) else None
    return None


def _first_object(text: str) -> dict | None:
    """From every opening brace on: the balanced part, if it parses; else the next brace is tried."""
    begin = text.find("{")
    while begin >= 0:
        end = _balanced_end(text, begin)
        found = _parsed(text[begin : end + 1]) if end > begin else None
        if found is not None:
            return found
        begin = text.find("{", begin + 1)
    return None


def first_object(text: str | None) -> str | None:
    """The first balanced object of a reply that parses, as JSON; trailing commas are forgiven."""
    found = _first_object(text or "")
    return None if found is None else json.dumps(found)


def _salvaged(text: str, keys: list[str]) -> list[dict] | None:
    """The complete objects of the first list named by one of ``keys``, up to its end, a broken item or the cut."""
    for key in keys:
        opened = re.search(rf'"{re.escape(key)}"\s*:\s*\[', text)
        found, at = [], opened.end() if opened else -1
        while at >= 0:
            begin, closed = text.find("{", at), text.find("]", at)
            if begin < 0 or 0 <= closed < begin:
                break
            end = _balanced_end(text, begin)
            item = _parsed(text[begin : end + 1]) if end > 0 else None
            if item is None:
                break
            found.append(item)
            at = end + 1
        if found:
            return found
    return None


def salvaged_items(text: str | None, keys: list[str]) -> str | None:
    found = _salvaged(text or "", keys)
    return None if found is None else json.dumps(found)


def _read(text: str | None, keys: list[str]) -> dict | None:
    """A reply's object with its list, else what can be salvaged, else its object without a list; null if malformed."""
    text = text or ""
    found = _first_object(text)
    listed = next((k for k in keys if isinstance((found or {}).get(k), list)), None)
    rows = found[listed] if listed else _salvaged(text, keys)
    if rows is not None and not listed:
        kind = re.search(r'"content_type"\s*:\s*"([^"]*)"', text)
        found = {"content_type": kind and kind[1]}
    if found is None:
        return None
    kind = found.get("content_type")
    return {
        "content_type": None if kind is None else str(kind),
        "items": None if rows is None else [json.dumps(x) for x in rows],
    }


def _arrow(f, kind: pa.DataType, sql: str):
    def run(values: pa.Array) -> pa.Array:
        # Python objects are made for a few rows at a time; a batch has thousands of replies, each with all of its items.
        parts = [pa.array([f(v) for v in values.slice(at, ROWS).to_pylist()], kind) for at in range(0, len(values), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    importable()
    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, sql)


def object_of(reply: Column) -> Column:
    return _arrow(first_object, pa.string(), "string")(strip_reasoning(reply))


def parsed(reply: Column, keys: list[str]) -> Column:
    """content_type and items (JSON texts) of a reply, in one pass; null where it is malformed."""
    kind = pa.struct([("content_type", pa.string()), ("items", pa.list_(pa.string()))])
    return _arrow(lambda t: _read(t, keys), kind, PARSED)(strip_reasoning(reply))


def items(reply: Column, keys: list[str]) -> Column:
    """The list of a reply as maps of strings: from its object, else from what can be salvaged; null if neither."""
    return F.transform(parsed(reply, keys)["items"], lambda x: F.from_json(x, ITEM))


def field(item: Column, *names: str) -> Column:
    """The first of a map's aliases that is there."""
    return F.coalesce(*(item[n] for n in names))


def discovery(replies: DataFrame, keys: list[str], kinds: list[str], key: str = "candidates") -> DataFrame:
    """Proposals of a reply: word ranges clamped into the window; others are invalid and flagged.

    ``replies``: keys, window_first, window_last, text.
    """
    each = replies.select(*keys, "window_first", "window_last", F.posexplode(items(F.col("text"), [key, "clips", "moments"])).alias("pos", "item"))
    first, last = whole(field(F.col("item"), "start", "start_word", "first")), whole(field(F.col("item"), "end", "end_word", "last"))
    inside = (first <= F.col("window_last")) & (last >= F.col("window_first")) & (first < last)
    kind = F.lower(F.trim(field(F.col("item"), "type", "moment_type")))
    bounds = (F.col("window_first"), F.col("window_last"))
    return each.select(
        *keys, "pos", F.coalesce(inside, F.lit(False)).alias("valid"),
        F.when(inside, clamp(first, *bounds)).alias("first"), F.when(inside, clamp(last, *bounds)).alias("last"),
        F.when(kind.isin(kinds), kind).otherwise("other").alias("kind"),
        unit(field(F.col("item"), "score", "confidence")).alias("score"),
    )


def known_only(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Reply rows about ids that were asked for."""
    return rows.join(known, on, "left_semi")


def coverage(got: Column, expected: Column, least: float) -> Column:
    """ok, incomplete, or schema for nothing usable (a null count is nothing)."""
    n = F.coalesce(got, F.lit(0))
    return F.when(expected == 0, "ok").when(n == 0, "schema").when(n / expected < least, "incomplete").otherwise("ok")


def vote(rows: DataFrame, key: str, value: str, share: float, default: str) -> DataFrame:
    """The value of most rows of a key if it has that share of all, else ``default``; two partial aggregations."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    top = counts.groupBy(key).agg(F.max_by(value, F.struct("c", value)).alias("top"), F.max("c").alias("c"), F.sum("c").alias("n"))
    return top.select(key, F.when(F.col("c") >= share * F.col("n"), F.col("top")).otherwise(default).alias("winner"), "n")
