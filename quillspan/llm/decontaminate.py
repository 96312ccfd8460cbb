"""Benchmark decontamination (operator 1).

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. Every run of ten
consecutive words of a benchmark item is a window; an item of fewer words, but not none, is one.
A document is normalised the same way (words joined by one blank) and scanned once by one Aho-Corasick automaton over
the items' normalised text; matches give word positions, and the words' offsets lead back to the original text.

The automaton holds an item cut at every fifth word: any ten consecutive words of the item have one such cut of five in them.
Where a cut is met, the document's windows around it are looked up among the items' windows (sorted 64-bit hashes, and
the words themselves compared). So a benchmark takes a fifth of its text in the automaton and 20 bytes a window,
about 110 MB a million words. Items of fewer than ten words are keys as they are.

Scale: the documents never shuffle. The benchmark is cut into pieces in the tasks and then taken in blocks of
``BLOCK_WORDS`` words, one after the other: the driver, the broadcast and every worker hold one block at a time. With more than one
block the documents' hits so far are written to the shared folder between two blocks.

Defined results: a null or wordless text has no words and no hits; very long texts are scanned whole; repeated document rows
are judged each for itself; repeated item ids count once; a null item id counts as the empty id; an empty benchmark hits nothing;
other columns of ``documents`` play no part and cannot clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, forget, free_name, text_struct, written

WINDOW, CUT = 10, 5
#: Words of the benchmark in one automaton, and so in one broadcast; words of one piece.
BLOCK_WORDS, PIECE_WORDS = 500_000, 5000

#: The same words in the original text, where A-Z are still capital.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = (
    "n_words long, runs array<struct<first: long, after: long>>, "
    "spans array<struct<begin: long, end: long>>, items array<string>"
)


def normal_words(text: str | None) -> list[bytes]:
    """The normalised words of a text, in UTF-8."""
    return (text or "").encode().translate(_NORMAL).split()


def window_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of the ten words from each place on."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WINDOW + 1
    g = np.zeros(max(n, 0), np.uint64)
    for k in range(WINDOW if n > 0 else 0):
        g = g * _MUL + h[k : n + k]
    return g


class Finder:
    """The automaton over (item id, normalised words in one line) pieces, and the windows behind it."""

    def __init__(self, pieces: list[tuple[str, str]]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.short: list[set[str]] = []  # items of each short key
        self.sizes: list[int] = []
        self.items, self.lines = [p[0] for p in pieces], [p[1].encode().split() for p in pieces]
        hashes, piece, place = [], [], []
        for k, words in enumerate(self.lines):
            if not words:
                continue
            if len(words) < WINDOW:
                key = f" {b' '.join(words).decode()} "
                value = self.automaton.get(key, 0)
                if value < 2:
                    self.short.append(set())
                    self.sizes.append(len(words))
                    value += 2 * len(self.short)
                    self.automaton.add_word(key, value)
                self.short[value // 2 - 1].add(self.items[k])
                continue
            for at in range(0, len(words) - CUT + 1, CUT):
                key = f" {b' '.join(words[at : at + CUT]).decode()} "
                self.automaton.add_word(key, self.automaton.get(key, 0) | 1)
            h = window_hashes(words)
            hashes.append(h)
            piece.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        none = [np.zeros(0, np.int32)]
        h = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.piece, self.place = h[order], np.concatenate(piece or none)[order], np.concatenate(place or none)[order]
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> tuple[set[tuple[int, int]], set[str]]:
        """Hit windows as word ranges, and the items."""
        ranges: set[tuple[int, int]] = set()
        found: set[str] = set()
        if not words or not len(self.automaton):
            return ranges, found
        line = f" {b' '.join(words).decode()} "
        ends, values = [], []
        for end, value in self.automaton.iter(line):
            ends.append(end)
            values.append(value)
        if not ends:
            return ranges, found
        blanks = np.array([m.start() for m in re.finditer(" ", line)])
        after = np.searchsorted(blanks, ends)
        values = np.array(values)
        for end, value in zip(after.tolist(), values.tolist(), strict=True):
            if value > 1:
                ranges.add((end - self.sizes[value // 2 - 1], end))
                found |= self.short[value // 2 - 1]
        cuts = after[values % 2 == 1] - CUT
        starts = np.unique((cuts[:, None] - np.arange(WINDOW - CUT + 1)).ravel())
        starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
        if len(starts):
            h = window_hashes(words)[starts]
            low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
            known = np.flatnonzero(high > low)
            for at, a, b in zip(starts[known].tolist(), low[known].tolist(), high[known].tolist(), strict=True):
                window = words[at : at + WINDOW]
                for k in range(a, b):
                    if self.lines[self.piece[k]][self.place[k] : self.place[k] + WINDOW] == window:
                        ranges.add((at, at + WINDOW))
                        found.add(self.items[self.piece[k]])
        return ranges, found

    def scan(self, text: str | None) -> tuple[int, list, list, list]:
        """Words in the text, hit runs as word ranges and as character spans of the original, and items."""
        words = normal_words(text)
        ranges, found = self.matches(words)
        runs: list[list[int]] = []
        for first, end in sorted(ranges):
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([first, end])
        offsets = [m.span() for m in WORD.finditer(text)] if runs else []
        spans = [(offsets[a][0], offsets[b - 1][1]) for a, b in runs]
        return len(words), [tuple(r) for r in runs], spans, sorted(found)


_LAST: dict[str, Finder] = {}


def _finder(name: str, pieces: list[tuple[str, str]]) -> Finder:
    """The finder of a block; a worker keeps one."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Finder(pieces)
    return _LAST[name]


def _scanner(shared):
    def setup():
        finder = _finder(*shared.value)

        def work(texts: list) -> list[list]:
            n, runs, spans, items = zip(*(finder.scan(t) for t in texts), strict=True) if texts else ([],) * 4
            return [
                list(n),
                [[{"first": a, "after": b} for a, b in r] for r in runs],
                [[{"begin": a, "end": b} for a, b in s] for s in spans],
                list(items),
            ]

        return work

    return text_struct(setup, _SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as pieces of bounded length that have nine words in common with the next."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = normal_words(text)
            for at in range(0, max(len(words) - WINDOW + 1, 1) if words else 0, PIECE_WORDS):
                part = words[at : at + PIECE_WORDS + WINDOW - 1]
                rows.append((item, b" ".join(part).decode(), len(part)))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["item", "line", "n"]
        )


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's pieces in blocks of bounded size, one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    pieces = items.mapInArrow(_cut, "item string, line string, n long")
    n = 1 + int((pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS)
    for k in range(n):
        part = pieces.filter(F.pmod(F.xxhash64("item", "line"), F.lit(n)) == k) if n > 1 else pieces
        yield sorted({(r.item, r.line) for r in part.select("item", "line").toLocalIterator()})


def _covered(runs: Column) -> Column:
    """How many words sorted, maybe overlapping runs cover."""
    total = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(
            F.greatest(s["to"], r["after"]).alias("to"),
            (s["n"] + F.greatest(F.lit(0), r["after"] - F.greatest(s["to"], r["first"]))).alias("n"),
        ),
    )
    return total["n"]


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with a struct column: n_words, n_hit, spans (original characters), items, contaminated."""
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    mine = [F.col(f"`{c}`") for c in docs.columns if c != out]
    seen = free_name("_seen", docs)
    found, before = docs, None
    for block in _blocks(benchmark):
        scanned = _scanner(context.broadcast((uuid.uuid4().hex, block)))(F.col(f"`{text}`"))
        if found is docs:
            found = docs.select("*", scanned.alias(seen))
            continue
        # The hits of earlier blocks are kept in a table, so a task never has more than one automaton.
        kept = written(found)
        if before is not None:
            forget(before)
        before, new = kept, free_name("_new", kept)
        both = kept.select("*", scanned.alias(new))
        gathered = [F.concat(F.col(f"{seen}.{x}"), F.col(f"{new}.{x}")).alias(x) for x in ("runs", "spans", "items")]
        found = both.select(
            *(F.col(f"`{c}`") for c in docs.columns), F.struct(F.col(f"{seen}.n_words").alias("n_words"), *gathered).alias(seen)
        )
    gather = lambda name: F.array_sort(F.array_distinct(F.col(f"{seen}.{name}")))
    return found.select(
        *mine,
        F.struct(
            F.col(f"{seen}.n_words").alias("n_words"),
            _covered(gather("runs")).alias("n_hit"),
            gather("spans").alias("spans"),
            gather("items").alias("items"),
            (F.size(F.col(f"{seen}.items")) > 0).alias("contaminated"),
        ).alias(out),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: what the benchmark has in common with it."""
    r = with_hits(docs.select("doc_id", "text"), benchmark)
    return r.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        "hits.contaminated",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    mark = free_name("_hits", docs)
    return with_hits(docs, benchmark, out=mark).filter(~F.col(f"{mark}.contaminated")).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )


_SQL_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, least({WINDOW}, len(ws)) AS k,
    array_to_string(ws[s : s + least({WINDOW}, len(ws)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS t(s) WHERE len(ws) > 0
),
docs AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
places AS (
  SELECT doc_id, k, s, array_to_string(ws[s : s + k - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT k FROM windows), unnest(range(1, len(ws) - k + 2)) AS t(s)
),
hits AS (SELECT doc_id, item, s, k FROM places JOIN windows USING (k, win)),
hit_words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM hits, unnest(range(s, s + k)) AS t(w) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
