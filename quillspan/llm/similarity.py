"""N-gram Jaccard join (operator 10) by vertical partitioning.

Words are runs of non-blank characters, A-Z lower-cased; a document's set holds its distinct five-word
shingles as 64-bit hashes (with fewer words, the whole sequence). Documents with equal sets are one
class from the start, whatever their number. Classes link at a Jaccard similarity of 0.8 or more.

All shingles have one global order: those seen often come last, others go by their hash. Cut into
fragments along that order, the first fragment of a set is its prefix, in which any two linked sets
share a shingle. The steps:

1. One pass over the texts: each set's fingerprint and size; also shingles that repeat within some
   millions of shingles, with counts. The latter are a hint for the order and never drop anything.
2. A second pass emits the prefixes (one row per shingle), shuffled once by shingle; shingles of one set go.
3. Likely pairs, two for each set at most: its prefix shingles offer it the set with the fewest rarer shingles and
   the next smaller one. Verified pairs give first classes.
4. Exact pairs: for shingles whose sets are still in different classes, pairs across classes of similar size, as far
   as sizes and positions in the order leave room for the overlap that a link needs; within a class nothing is paired.
   The pairs' overlaps in the prefix fragment are counted, and most pairs have too little in common there.
5. Verification: the sets of the pairs are cut into fragments of the global order; overlaps are counted
   fragment by fragment and summed per pair.
6. Components over all verified pairs, by rounds of star contraction.

Texts never shuffle, but for those of sets in pairs if their list is too large to broadcast.
64-bit hashes stand for shingles and sets: two different ones collide with a chance of about 5e-20.

Defined results: a null or blank text has an empty set, links with nothing and is its own component;
repeated rows (also of one doc_id) are copies of each other; a null doc_id takes part, but is never a
component's name unless it is alone; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, forget, free_name, small_side, text_struct, written
from quillspan.llm.graph import components

SHINGLE = 5
#: Similarity as a fraction of integers: 100 * intersection >= 80 * union.
PERCENT = 80
#: Fragments of the global order in a verification.
FRAGMENTS = 8
#: Shingles that a task counts at once, the least repeats it reports, and the most hints that are broadcast (16 bytes each).
COUNTED, REPEATS, HINTS = 3_000_000, 3, 500_000
#: Shared prefix shingles beyond the first that an exact pair must show.
MORE = 4
#: Words whose hashes a worker keeps, and sets that a task remembers as emitted.
KEPT_WORDS, KEPT_SETS = 300_000, 500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64).view(np.int64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    g = h[:n].copy()
    for k in range(1, size):
        g = g * _MUL + h[k : n + k]
    g ^= g >> np.uint64(29)
    g *= _MIX
    g ^= g >> np.uint64(32)
    return np.unique(g.view(np.int64))


def fingerprint(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_size(n: int) -> int:
    """Two sets linked share a shingle among the first so many of each."""
    return n - -(-PERCENT * n // 100) + 1


def _columns(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("token", pa.int64()), ("seen", pa.int32())])
_PREFIX = pa.schema([("token", pa.int64()), ("fp", pa.int64()), ("place", pa.int64())])
_PARTS = pa.schema([("fp", pa.int64()), ("fragment", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[np.ndarray] = []

    def repeats() -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(waiting), return_counts=True)
        waiting.clear()
        often = seen >= REPEATS
        none = [None] * int(often.sum())
        return _columns(_SETS, none, none, none, tokens[often], seen[often])

    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        none = [None] * len(sets)
        prints = [fingerprint(s) if len(s) else None for s in sets]
        yield _columns(_SETS, batch.column("doc_id"), list(map(len, sets)), prints, none, none)
        for s in sets:
            waiting.append(s)
            if len(waiting) % 256 == 0 and sum(map(len, waiting)) >= COUNTED:
                yield repeats()
    if waiting:
        yield repeats()


def _ordered(tokens: np.ndarray, hint: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """Tokens in the global order, and how many of them come before the hinted ones."""
    often, seen = hint
    if not len(often) or not len(tokens):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
    count = np.where(often[at] == tokens, seen[at], 0)
    order = np.lexsort((tokens, count))
    return tokens[order], int((count == 0).sum())


def _prefixes(hint):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted: set[int] = set()
        for batch in batches:
            tokens, prints, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                if not len(s) or (fp := fingerprint(s)) in emitted:
                    continue
                if len(emitted) >= KEPT_SETS:
                    emitted.clear()
                emitted.add(fp)
                first = _ordered(s, hint.value)[0][: prefix_size(len(s))]
                tokens.append(first)
                prints.append(np.full(len(first), fp))
                sizes.append((len(s) << 32) + np.arange(len(first)))  # size and position in one number
            if tokens:
                yield _columns(_PREFIX, np.concatenate(tokens), np.concatenate(prints), np.concatenate(sizes))

    return run


def _parts(hint):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, fragments, parts = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                ordered, rare = _ordered(s, hint.value)
                # Equal cuts of the hash range among the unhinted; the hinted are the last fragment.
                cut = [0, *np.searchsorted(ordered[:rare], [-(1 << 63) + (k << 64) // (FRAGMENTS - 1) for k in range(1, FRAGMENTS - 1)]), rare, len(s)]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):  # noqa: B905
                    if b > a:
                        prints.append(fingerprint(s))
                        fragments.append(k)
                        parts.append(ordered[a:b])
            yield _columns(_PARTS, prints, fragments, parts)

    return run


def _hint(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated shingles (sorted) and their counts, ``HINTS`` of them at most."""
    counts = seen.groupBy("token").agg(F.sum("seen").alias("seen")).withColumn("level", F.least("seen", F.lit(1000)))
    levels = sorted(counts.groupBy("level").count().collect(), key=lambda r: -r.level)
    total, least = 0, None
    for r in levels:
        if (total := total + r["count"]) > HINTS:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.filter(F.col("level") >= least).select("token", "seen").toArrow()
    tokens, n = rows.column("token").to_numpy(), rows.column("seen").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _similar_size(a: str, b: str):
    return F.expr(f"100L * least({a}, {b}) >= {PERCENT}L * greatest({a}, {b})")


def _verified(texts: DataFrame, named: DataFrame, pairs: DataFrame, hint, nulls: bool) -> DataFrame:
    """The pairs of a written table (a, b, na, nb) that link, written: partial overlaps by fragment, summed.

    ``nulls``: there are null doc_ids. The table of pairs is deleted.
    """
    nodes = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    sought = written(named.join(nodes, "fp", "left_semi"))
    ids = sought.filter("doc is not null").select(F.col("doc").alias("doc_id"))
    chosen = texts.join(small_side(ids), "doc_id", "left_semi")
    # Written without a shuffle; a repeated doc_id may give a set's parts twice, which the maximum evens out.
    cut = lambda rows: rows.select("text").mapInArrow(_parts(hint), "fp long, fragment int, tokens array<long>")
    parts = cut(chosen)
    if nulls:  # a set whose doc_ids are all null is found by its fingerprint
        nameless = small_side(sought.filter("doc is null").select("fp"))
        parts = parts.unionByName(cut(texts.filter("doc_id is null")).join(nameless, "fp", "left_semi").dropDuplicates(["fp", "fragment"]))
    parts = written(parts)
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    left = parts.select(F.col("fp").alias("a"), "fragment", F.col("tokens").alias("x"))
    right = parts.select(F.col("fp").alias("b"), "fragment", F.col("tokens").alias("y"))
    partial = each.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).select(
        "a", "b", "na", "nb", "fragment", F.size(F.array_intersect("x", "y")).cast("long").alias("both")
    )
    once = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("both").alias("both"))
    total = once.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    links = written(total.filter(F.expr(f"100L * both >= {PERCENT}L * (na + nb - both)")).select("a", "b"))
    forget(sought, parts, pairs)
    return links


def _offers(shared: DataFrame) -> DataFrame:
    """(fp, n, kind, other): of each shingle the set with fewest rarer shingles before it, and the next smaller set; other has fp and n."""
    by_size = Window.partitionBy("token").orderBy("n", "fp")
    first = F.min(F.struct("pos", "fp", "n")).over(Window.partitionBy("token"))
    hub = F.struct(first["fp"].alias("fp"), first["n"].alias("n"))
    seen = shared.select("fp", "n", hub.alias("hub"), F.lag(F.struct("fp", "n")).over(by_size).alias("next"))
    return seen.select("fp", "n", F.expr("stack(2, 0, hub, 1, next) as (kind, other)")).filter("other.fp != fp")


def _likely(offers: DataFrame) -> DataFrame:
    """(a, b, na, nb): of each kind, the set that most of a set's shingles offer, if enough of them do."""
    best = (
        offers.groupBy("fp", "n", "kind", "other").agg(F.count("*").alias("c")).filter("50 * c >= n")
        .groupBy("fp", "n", "kind").agg(F.max_by("other", F.struct("c", "other")).alias("other"))
    )
    smaller = lambda x, y: F.expr(f"if(fp < other.fp, {x}, {y})")
    return best.filter(_similar_size("n", "other.n")).select(
        smaller("fp", "other.fp").alias("a"), smaller("other.fp", "fp").alias("b"), smaller("n", "other.n").alias("na"), smaller("other.n", "n").alias("nb")
    ).distinct()


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, fp, n, pos, root, major) of the shingles whose sets are in several classes; major is the largest."""
    root = small_side(roots.select(F.col("node").alias("fp"), "root"))
    classed = shared.join(root, "fp", "left").select("token", "fp", "n", "pos", F.coalesce("root", "fp").alias("root"))
    mixed = (
        classed.groupBy("token", "root").agg(F.count("*").alias("c"))
        .groupBy("token").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("c", "root")).alias("major"))
        .filter("classes > 1")
    )
    return classed.join(mixed.select("token", "major"), "token")


def linked(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _classed(docs).select("doc_id", "n_shingles", "component_id")


def _classed(docs: DataFrame) -> DataFrame:
    """linked(), and each row's set and the root of its class; both are null where the set is empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(texts.mapInArrow(_sets, "doc_id long, n int, fp long, token long, seen int"))
    sets = first.filter("n is not null").select("doc_id", "n", "fp")
    hint = spark.sparkContext.broadcast(_hint(first.filter("token is not null")))
    named = sets.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    nulls = not sets.filter("doc_id is null and fp is not null").isEmpty()

    # Sets by shared prefix shingle; shingles of one set only are gone.
    prefix = texts.select("text").mapInArrow(_prefixes(hint), "token long, fp long, place long")
    by = prefix.withColumn("low", F.expr("min(fp) over (partition by token)")).withColumn("high", F.expr("max(fp) over (partition by token)"))
    shared = written(
        by.filter("low != high").select(
            "token", "fp", F.expr("cast(shiftright(place, 32) as int)").alias("n"), F.expr("cast(place & 4294967295 as int)").alias("pos")
        ).dropDuplicates(["token", "fp"])
    )

    likely = written(_likely(_offers(shared)))
    linked_1 = _verified(texts, named, likely, hint, nulls)
    roots_1 = components(linked_1)
    rows = written(_mixed(shared, roots_1))
    forget(shared)

    # Exact pairs across the classes found so far.
    # Of a linked pair, the first shingles up to the overlap it needs (and a few more) have at least as many in common
    # as there are more; rows further on in either set are of no use.
    minor = rows.filter("root != major").select(
        "token", F.col("fp").alias("fp_x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"), F.col("root").alias("root_x")
    )
    need = F.expr(f"cast(ceil({PERCENT} * (cast(n as long) + n_x) / {100 + PERCENT}) as int)")
    more = F.least(F.lit(MORE), need - F.expr(f"cast(ceil({PERCENT} * cast(greatest(n, n_x) as long) / 100) as int)") + 1)
    crossed = minor.join(rows, "token").filter(
        (F.col("root_x") != F.col("root"))
        & ((F.col("root") == F.col("major")) | (F.col("fp_x") < F.col("fp")))
        & _similar_size("n", "n_x")
        & (F.col("pos") < F.col("n") - need + more)
        & (F.col("pos_x") < F.col("n_x") - need + more)
    )
    ordered = F.col("fp_x") < F.col("fp")
    pick = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    counted = crossed.groupBy(
        pick("fp_x", "fp").alias("a"), pick("fp", "fp_x").alias("b"), pick("n_x", "n").alias("na"), pick("n", "n_x").alias("nb"), more.alias("more")
    ).agg(F.count("*").alias("c"))
    exact = counted.filter("c >= more").drop("c", "more")
    linked_2 = _verified(texts, named, written(exact), hint, nulls)
    roots = components(roots_1.toDF("a", "b").unionByName(linked_2))

    # From sets to documents. Both sides of every join on a set or a class are tables, small or split by AQE where one is hot.
    nodes = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    rooted = written(named.join(nodes, "fp"))
    names = written(rooted.groupBy("root").agg(F.min("doc").alias("component_id")))
    several = rooted.join(small_side(names), "root").select("fp", "root", "component_id")
    by_set = written(
        named.join(several, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    )
    forget(rows, linked_1, linked_2, rooted, names)
    return sets.join(small_side(by_set), "fp", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "fp", "root"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (the one with the least doc_id), with all its columns.

    Rows of a null or repeated doc_id are told apart by their sets; of those with an empty set all stay. Of rows that are alike in
    doc_id and set any one stays. Documents with unique ids are kept by an anti-join on the id, without reading their texts again.
    """
    found = written(_classed(docs))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    nulls, repeats = not found.filter("doc_id is null").isEmpty(), not repeated.isEmpty()
    gone = found.filter("component_id != doc_id").select("doc_id")
    gone = (gone.unionByName(repeated) if repeats else gone).distinct()
    left = docs.filter("doc_id is not null").join(small_side(gone), "doc_id", "left_anti").select(*columns)
    if not nulls and not repeats:
        return left

    def prints():
        def work(texts: list) -> list[list]:
            return [[fingerprint(s) if len(s) else None for s in map(shingles, texts)]]

        return work

    fp, root, component = (free_name(x, docs) for x in ("_fp", "_root", "_component"))
    again = small_side(repeated)
    odd = lambda rows: rows.filter("doc_id is null").unionByName(rows.join(again, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in rows.columns)))
    classes = odd(found).filter("fp is not null").select(
        F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(component)
    ).distinct()
    rows = odd(docs.select(*columns)).select(*columns, text_struct(prints, "fp long")(F.col("text"))["fp"].alias(fp))
    of_classes = rows.join(small_side(classes), fp).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(component)))
    first = of_classes.dropDuplicates([root]).select(*columns)
    return left.unionByName(first).unionByName(rows.filter(F.col(fp).isNull()).select(*columns))


ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s : s + {SHINGLE} - 1], ' ') AS g
  FROM words, unnest(range(1, greatest(len(ws) - {SHINGLE} + 1, 1) + 1)) AS t(s) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""
