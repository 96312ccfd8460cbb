"""Periodic run detection (operator 12) by internal pattern matching.

A run is a stretch of words with smallest period q and a length of at least max(12, 2q) that no neighbouring word extends. The documents of
a batch are one sequence of words, in which words of different documents differ, so nothing is found across documents:

1. Prefix doubling ranks the blocks of 1, 2, 4, ... words at every position and ends in the suffix array; a block's occurrences are an
   interval of it. Only positions whose block is not alone go on to the next size.
2. A wavelet tree over the suffix array answers the range successor: how many occurrences of a block lie before a position, and
   which is the next.
3. A run of period q in [2b - 1, 4b - 2], b a power of two, has a dyadic block of b words in its first period, and the block's copy q words
   further on. So each dyadic block asks for its occurrences in these neighbouring windows. In a window of half a block they
   are a progression, known by its first, its difference and their number; its members are candidate periods, unless all lie in one
   run of that difference with the block (then none of them is a smallest period).
4. Ranks of blocks, the longest first, tell how far a candidate reaches to both sides. Of equal stretches the smallest period counts.

That is O(n log n) numbers for n words, repetitive or not; windows of a block of one word are neighbours and are compared at once. Words
are told apart by 64-bit hashes.

Defined results: a null, empty or blank text has no words and no runs; a very long text is one sequence whatever its length; repeated
rows are worked on each for itself; an empty table gives an empty one; other columns stay out of it. In ``query`` a null doc_id
is nobody's number, so its words stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, text_struct
from quillspan.llm.similarity import HASHES

LEAST = 12
#: Words that are worked on as one sequence, but for a longer text of its own.
WORDS = 150_000
WORD = r"[^\x20\x09-\x0D]+"

_DOCUMENT = np.uint64(0x9E3779B97F4A7C15)


class SuffixOrder:
    """The suffix array of a sequence, the ranks of its blocks by size, and the dyadic blocks that are not alone."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        sa = np.argsort(codes).astype(np.int64)
        slots, key = np.arange(n), codes[sa]
        rank = np.zeros(n, np.int32)
        self.ranks: list[np.ndarray] = []
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of 2**k words: where, and the interval of its occurrences
        size = 1
        while len(slots):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            last = np.r_[first[1:], len(key)]
            several = np.repeat(last - first > 1, last - first)
            low, high = np.repeat(slots[first], last - first), np.repeat(slots[last - 1] + 1, last - first)
            rank[sa[slots]] = low
            slots, low, high = slots[several], low[several], high[several]
            if not len(slots):
                break
            self.ranks.append(rank.copy())
            dyadic = sa[slots] % size == 0
            self.blocks.append((sa[slots][dyadic], low[dyadic], high[dyadic]))
            if size == 2:
                self.shared = slots
            # A block that is not alone has no separator, so another one of its size can follow.
            key = low * n + rank[sa[slots] + size]
            order = np.argsort(key)
            sa[slots], key = sa[slots][order], key[order]
            size *= 2
        self.sa = sa

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and from y on are the same."""
        x, y, reach = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (self.ranks[k][x] == self.ranks[k][y]).astype(np.int64) << k
            x, y, reach = x + same, y + same, reach + same
        return reach

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x and before y are the same; x < y."""
        reach = np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            from_x, from_y = x - reach - (1 << k), y - reach - (1 << k)
            same = (from_x >= 0) & (self.ranks[k][np.maximum(from_x, 0)] == self.ranks[k][np.maximum(from_y, 0)])
            reach += same.astype(np.int64) << k
        return reach


class WaveletTree:
    """Numbers by their bits, the highest first: for each bit, how many zeros lie before a place."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(int(values.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.levels.append((bit, np.r_[0, np.cumsum(~one)].astype(np.int32)))
            values = np.r_[values[~one], values[one]]

    def before(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers at the places from low to high are less than a value."""
        out, everything = np.zeros(len(low), np.int64), high - low
        above = value >> self.levels[0][0] + 1 > 0
        for bit, zeros in self.levels:
            at, to, total = zeros[low], zeros[high], zeros[-1]
            one = value >> bit & 1 > 0
            out += np.where(one, to - at, 0)
            low, high = np.where(one, total + low - at, at), np.where(one, total + high - to, to)
        return np.where(above, everything, out)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest (from 0) of the numbers at the places from low to high."""
        out = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            at, to, total = zeros[low], zeros[high], zeros[-1]
            one = n >= to - at
            n = np.where(one, n - (to - at), n)
            out += one.astype(np.int64) << bit
            low, high = np.where(one, total + low - at, at), np.where(one, total + high - to, to)
        return out


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 0, 3: of what each is a part (0 0 2 2 2), and its number there (0 1 0 1 2)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _occurrences(order: SuffixOrder, tree: WaveletTree, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dyadic blocks of 2**k words, k > 0, and distances at which they come again that may be smallest periods."""
    block = 1 << k
    x, low, high = order.blocks[k]
    low, high = places[low], places[high - 1] + 1
    near, far = x + 2 * block - 1, x + 4 * block - 1
    begin, end = tree.before(low, high, near), tree.before(low, high, far)
    some = end > begin
    x, low, high, near, begin, end = (v[some] for v in (x, low, high, near, begin, end))
    edges = [begin, *(tree.before(low, high, near + part * block // 2) for part in (1, 2, 3)), end]
    # Progressions, one a window of half a block.
    counts = np.concatenate([b - a for a, b in zip(edges, edges[1:], strict=False)])
    x, low, high, start = np.tile(x, 4), np.tile(low, 4), np.tile(high, 4), np.concatenate(edges[:-1])
    some = counts > 0
    x, low, high, start, counts = (v[some] for v in (x, low, high, start, counts))
    first, step = tree.nth(low, high, start), np.zeros(len(x), np.int64)
    more = counts > 1
    step[more] = tree.nth(low[more], high[more], start[more] + 1) - first[more]
    many = np.flatnonzero(counts > 2)
    reach = order.forward(x[many], x[many] + step[many])
    counts[many[reach >= first[many] + (counts[many] - 2) * step[many] + block - x[many]]] = 0
    of, j = _spread(counts)
    return x[of], first[of] + j * step[of] - x[of]


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start and period; separators are codes that occur once, one of them at the end."""
    order = SuffixOrder(codes)
    xs, ds = [], []
    for d in (1, 2):  # the windows of blocks of one word
        same = np.r_[False, codes[d:] == codes[:-d]]
        at = np.flatnonzero(same[1:] & ~same[:-1])
        xs.append(at)
        ds.append(np.full(len(at), d))
    if len(order.blocks) > 1:
        places = np.zeros(len(codes), np.int64)
        places[order.shared] = np.arange(len(order.shared))
        tree = WaveletTree(order.sa[order.shared])
        for k in range(1, len(order.blocks)):
            x, d = _occurrences(order, tree, places, k)
            xs.append(x)
            ds.append(d)
    x, d = np.concatenate(xs), np.concatenate(ds)
    before = order.backward(x, x + d)
    start, length = x - before, before + order.forward(x, x + d) + d
    long = length >= np.maximum(LEAST, 2 * d)
    start, length, d = start[long], length[long], d[long]
    by = np.lexsort((d, length, start))
    start, length, d = start[by], length[by], d[by]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, d = start[new], length[new], d[new]
    by = np.lexsort((d, start))
    return start[by], length[by], d[by]


def _found(documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Of each document its runs, and its text without what repeats in them."""
    sizes = np.array([len(w) + 1 for w in documents])
    starts = np.cumsum(sizes) - sizes
    codes = np.fromiter((h for words in documents for h in (*map(HASHES.__getitem__, words), 0)), np.uint64, int(sizes.sum()))
    with np.errstate(over="ignore"):
        codes += np.repeat(np.arange(1, len(documents) + 1, dtype=np.uint64) * _DOCUMENT, sizes)
    start, length, period = runs(codes)
    document = np.searchsorted(starts, start, "right") - 1
    edges = np.searchsorted(document, np.arange(len(documents) + 1))
    out = []
    for k, words in enumerate(documents):
        a, b = edges[k], edges[k + 1]
        if a < b:
            s, e = start[a:b] - starts[k], start[a:b] - starts[k] + length[a:b]
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, s + period[a:b], 1)
            np.add.at(cover, e, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            triples = list(zip(s.tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        else:
            triples = []
        out.append((triples, b" ".join(words).decode()))
    return out


def _setup():
    def work(texts: list) -> list[list]:
        out, waiting, n = [], [], 0
        for k, text in enumerate(texts):
            waiting.append((text or "").encode().split())
            n += len(waiting[-1])
            if n >= WORDS or k + 1 == len(texts):
                out += _found(waiting)
                waiting, n = [], 0
        return [[r for r, _ in out], [c for _, c in out]]

    return work


def periodic(text: Column) -> Column:
    """(runs, collapsed) of a text: its runs by start and period, and its words outside of runs or in a run's first period."""
    return text_struct(_setup, "runs array<struct<start: long, length: long, period: long>>, collapsed string")(text)


def with_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, runs and collapsed of every document, or of another text made from its columns."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", periodic(F.col("text") if text is None else text).alias("_r")).select("doc_id", "_r.*")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document in ten, chosen by its doc_id's crc32, repeats some of its words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Java's patterns and bytes.split agree on what is blank; only the chosen texts are taken apart here.
    parts = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    parts = parts.select("*", F.when(n > 0, F.expr("cast(g % size(words) as int)")).alias("a"))
    parts = parts.select("*", F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)").alias("p"))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, element_at(words, a + (i - a) % p + 1))), ' ')")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    found = with_runs(planted(docs))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
