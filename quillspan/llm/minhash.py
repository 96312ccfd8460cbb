"""MinHash near-dedup (operator 13): a multi-index Hamming join of b-bit signatures, links confirmed on full sets.

Words are runs of non-blank characters, A-Z lower-cased; a document's set holds its distinct three-word shingles as 64-bit
hashes (with fewer words, the whole sequence). Documents link where 100 * intersection >= 85 * union. Documents with equal sets are
one class from the start.

A signature has 64 minima, of each of which 16 bits are kept. Its distance is the number of minima that differ: at a similarity of 0.85 each
does with a chance of 0.15, so a linked pair is further apart than 27 with a chance of 4e-8 at most (binomial), and no pair up to 27 is
lost: cut into 14 chunks, two signatures at such a distance differ in at most one minimum of some chunk (pigeonhole). Each chunk's
allowed errors are enumerated as the keys that leave out one of its minima: 64 keys a set, and two such signatures share one.

1. One pass over the texts: fingerprint, size and signature of each set; sets are told apart by fingerprint from then on.
2. Keys are counted; those of one set only go. A set is the more typical, the more sets share its keys.
3. Hubs: in each key the most typical set is offered to the others, and a set keeps the one that most of its keys offer, within the distance. Verified
   pairs give classes.
4. Exact pairs: keys whose sets are still in several classes give the sets that may have links across classes. Pairs of them are listed where they
   share one of the shingles that fewest of these sets have, as near the front of both sets' orders as the overlap of a link
   needs; so copies with much of their own are not paired with their whole group. Within a class nothing is paired. Each set also has a
   word of parities: the sets of a pair differ in at least as many shingles as their words differ in bits, and a pair that
   differs in more than a link allows is no row. So near copies that do not link are compared, but not listed.
5. Every pair within the distance is verified on its full sets; components go by rounds of star contraction.

Texts never shuffle. 64-bit hashes stand for shingles and sets: two different ones collide with a chance of about 5e-20.

Defined results: a null or blank text has an empty set, links with nothing and is its own component; repeated rows (also of one
doc_id) are copies of each other and are kept or not alike; a null doc_id takes part, but names a component, and is kept, only if all
rows of the component are without; very long texts are read whole; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import similarity
from quillspan.llm.common import bounded_batches, forget, small_side, written
from quillspan.llm.graph import components

SHINGLE, PERCENT = 3, 85
#: Minima of a signature, chunks it is cut into, and the distance up to which no pair is lost (one error in some chunk).
MINIMA, CHUNKS = 64, 14
DISTANCE = 2 * CHUNKS - 1
#: Shingles before one that tell whether a pair has been listed there.
BEFORE = 3
#: Bits of a set's word of parities, as longs of 64 (128 bytes).
LONGS = 16
#: Shingles hashed at once, so that the 64 rows stay in a core's cache.
SLICE = 1024

_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"seed %d" % k) for k in range(MINIMA)], np.uint64)[:, None]
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"multiplier %d" % k) | 1 for k in range(MINIMA)], np.uint64)[:, None]
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("sig", pa.list_(pa.int16()))])
_TOKENS = pa.schema([("fp", pa.int64()), ("tokens", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])


def shingles(text: str | None) -> np.ndarray:
    return similarity.shingles(text, SHINGLE)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the 64 minima of a set that is not empty."""
    least = None
    for at in range(0, len(tokens), SLICE):
        x = (tokens[at : at + SLICE].view(np.uint64)[None, :] ^ _SEEDS) * _MULTIPLIERS
        x ^= x >> np.uint64(32)
        part = x.min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint16).view(np.int16)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Of each of ``64 * LONGS`` cells, whether an odd number of a set's shingles lies in it."""
    cells = tokens.view(np.uint64) % np.uint64(64 * LONGS)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=64 * LONGS).astype(np.uint8) & 1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and size of each row, and the signature where the task has not given it yet."""
    given: set[int] = set()
    for batch in batches:
        sizes, prints, signatures = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = shingles(text)
            fp = similarity.fingerprint(tokens) if len(tokens) else None
            sizes.append(len(tokens))
            prints.append(fp)
            signatures.append(None if fp is None or fp in given else signature(tokens))
            if len(given) >= similarity.KEPT_SETS:
                given.clear()
            given.add(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip((batch.column("doc_id"), sizes, prints, signatures), _SIGNED.types, strict=True)], schema=_SIGNED
        )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in map(shingles, batch.column("text").to_pylist()) if len(s)]
        columns = ([similarity.fingerprint(s) for s in sets], sets, list(map(parity, sets)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TOKENS.types, strict=True)], schema=_TOKENS)


def _keys() -> Column:
    """For every chunk and every minimum that may be wrong: a hash of the others."""
    edges = [MINIMA * k // CHUNKS for k in range(CHUNKS + 1)]
    sig = F.col("sig")
    return F.array(
        *(F.xxhash64(F.lit(wrong), *(sig[k] for k in range(a, b) if k != wrong)) for a, b in zip(edges, edges[1:], strict=False) for wrong in range(a, b))
    )


def _similar_size(a: str, b: str) -> Column:
    return F.expr(f"100L * least({a}, {b}) >= {PERCENT}L * greatest({a}, {b})")


def _distance(x: str, y: str) -> Column:
    """In how many minima two signatures differ."""
    return F.expr(f"size(filter(zip_with({x}, {y}, (a, b) -> a != b), d -> d))")


def _least_difference(x: str, y: str) -> Column:
    """In how many shingles two sets differ at the least, by their words of parities."""
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(1, LONGS)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _near(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b, na, nb, distance) of the (a, b) pairs whose signatures are within the distance."""
    side = lambda x: named.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig_{x}"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").filter(_similar_size("na", "nb"))
        .select("a", "b", "na", "nb", _distance("sig_a", "sig_b").alias("distance")).filter(F.col("distance") <= DISTANCE)
    )


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The (a, b) pairs that link on their full sets, written."""
    left, right = (tokens.select(F.col("fp").alias(x), F.col("tokens").alias(t)) for x, t in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("both"))
    return written(both.filter(F.expr(f"100L * both >= {PERCENT}L * (na + nb - both)")).select("a", "b").distinct())


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _offers(rows: DataFrame, hubs: DataFrame, named: DataFrame) -> DataFrame:
    """The hub that most of a set's keys offer, if it is within the distance, as (a, b, na, nb): one pair a set at most."""
    counted = rows.join(hubs, "key").filter("fp != hub").groupBy("fp", "hub").agg(F.count("*").alias("c"))
    best = counted.groupBy("fp").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    return _near(best.select(*_ordered("fp", "hub")).distinct(), named).drop("distance")


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of keys whose sets are in several classes, with each set's class and the key's largest."""
    root = small_side(roots.select(F.col("node").alias("fp"), "root"))
    classed = shared.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = (
        classed.groupBy("key", "root").agg(F.count("*").alias("c"))
        .groupBy("key").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("c", "root")).alias("major")).filter("classes > 1")
    )
    return classed.join(mixed.select("key", "major"), "key")


def _rarest(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, fp, n, root, pos, before) of the sets of mixed keys: shingles that sets of other classes have, too, the rarest first.

    ``before``: up to three shingles that come right before it in the set's order. A set's own shingles, which no other class has, come before them in the order and need no rows. Two sets that link have one in common
    among the first so many of each; a set with too many of its own has no rows at all.
    """
    each = tokens.join(rows.select("fp", "root", "n").distinct(), "fp").select("fp", "root", "n", F.explode("tokens").alias("token"))
    several = each.groupBy("token").agg(F.count("*").alias("sets"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    ordered = each.join(several.select("token", "sets"), "token").groupBy("fp", "n", "root").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("s"))
    own = F.col("n") - F.size("s")
    first = F.col("n") - F.expr(f"cast(ceil({PERCENT} * n / 100) as int)") + 1 - own
    cut = ordered.filter(first > 0).select("fp", "n", "root", own.alias("own"), F.transform(F.slice("s", F.lit(1), F.greatest(F.lit(0), first)), lambda t: t["token"]).alias("s"))
    before = F.slice("s", F.greatest(F.lit(1), F.col("at") + 1 - BEFORE), F.least(F.col("at"), F.lit(BEFORE)))
    return cut.select("fp", "n", "root", "own", "s", F.posexplode("s").alias("at", "token")).select("token", "fp", "n", "root", (F.col("own") + F.col("at")).alias("pos"), before.alias("before"))


def _crossed(rarest: DataFrame, named: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb) across classes, within the distance: sets that share one of their rarest shingles early enough for the overlap of a link,
    and whose parities leave room for it.

    Sets meet in bands of size, so a hot shingle is dealt by band; within a class nothing is paired. A pair that shares a shingle right before this
    one has been listed there, and the first one that it shares always lists it.
    """
    classes = rarest.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("c", "root")).alias("major"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT)).cast("int")
    rows = rarest.join(classes.filter("classes > 1").select("token", "major"), "token").withColumn("band", band)
    rows = rows.join(named.select("fp", "sig").join(tokens.select("fp", "parity"), "fp"), "fp")
    minor = rows.filter("root != major").select(
        "token", *(F.col(c).alias(f"{c}_x") for c in ("fp", "n", "root", "pos", "before", "sig", "parity")), F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band")
    )
    need = F.expr(f"cast(ceil({PERCENT} * (cast(n as long) + n_x) / {100 + PERCENT}) as int)")
    crossed = minor.join(rows, ["token", "band"]).filter(
        (F.col("root_x") != F.col("root"))
        & ((F.col("root") == F.col("major")) | (F.col("fp_x") < F.col("fp")))
        & _similar_size("n", "n_x")
        & (F.col("pos") <= F.col("n") - need)
        & (F.col("pos_x") <= F.col("n_x") - need)
        & (_least_difference("parity", "parity_x") <= F.col("n") + F.col("n_x") - 2 * need)
        & ~F.arrays_overlap("before", "before_x")
        & (_distance("sig", "sig_x") <= DISTANCE)
    )
    smaller = lambda x, y: F.expr(f"if(fp_x < fp, {x}, {y})")
    return crossed.select(*_ordered("fp_x", "fp"), smaller("n_x", "n").alias("na"), smaller("n", "n_x").alias("nb")).distinct()


def classed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(texts.mapInArrow(_signed, "doc_id long, n int, fp long, sig array<smallint>"))
    named = written(
        sets.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig", True).alias("sig"))
    )

    # Keys of at least two sets, and how typical a set is.
    keys = named.select("fp", F.explode(_keys()).alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1")
    found = written(keys.join(several, "key"))
    typical = written(found.groupBy("fp").agg(F.sum("sets").alias("typical")).join(named.select("fp", "n"), "fp"))
    shared = written(found.select("key", "fp").join(small_side(typical), "fp"))

    # Full sets of what shares a key, cut from the texts once.
    sought = written(named.select("fp", "doc").join(typical, "fp", "left_semi"))
    kind = "fp long, tokens array<long>, parity array<long>"
    tokens = texts.join(small_side(sought.filter("doc is not null").select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi").select("text").mapInArrow(_tokens, kind)
    nameless = sought.filter("doc is null").select("fp")
    if not nameless.isEmpty():  # sets of rows without an id are found by their fingerprints
        without = texts.filter("doc_id is null").select("text").mapInArrow(_tokens, kind)
        tokens = tokens.unionByName(without.join(small_side(nameless), "fp", "left_semi").dropDuplicates(["fp"]))
    tokens = written(tokens)

    hubs = shared.groupBy("key").agg(F.max_by("fp", F.struct("typical", "fp")).alias("hub"))
    likely = written(_offers(shared, hubs, named))
    links = _verified(likely, tokens)
    roots_1 = components(links)
    rows = written(_mixed(shared, roots_1))
    rarest = written(_rarest(rows, tokens))
    exact = written(_crossed(rarest, named, tokens))
    last = _verified(exact, tokens)
    roots = components(roots_1.toDF("a", "b").unionByName(last))

    # From sets to documents; sides of joins are tables, small or split by AQE where one is hot.
    nodes = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    rooted = written(named.select("fp", "doc").join(nodes, "fp"))
    names = written(rooted.groupBy("root").agg(F.min("doc").alias("name")))
    linked = rooted.join(small_side(names), "root").select("fp", "name")
    by_set = written(
        named.select("fp", "doc").join(linked.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.expr("if(linked, name, doc)").alias("component_id"))
    )
    forget(named, found, typical, shared, sought, tokens, likely, links, rows, rarest, exact, last, rooted, names)
    return sets.join(small_side(by_set), "fp", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


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
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""
