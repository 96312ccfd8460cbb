"""Filter interaction audit (operator 11): available-now micro-batches, keyed text state, retractions into counters of parts.

Which of five filters fails on a document is a mask of five bits; how the filters act on each other, in every order, follows from
how many documents of a part (a value of ``source``) have each mask. Four bits are expressions over the text. The fifth, a copy of a text
with a smaller doc_id anywhere in the table, is kept by a stream over all files:

1. A micro-batch turns documents into (digest of the text, mask, part, label flags, doc_id); texts go no further. Copies within a task are
   put together first (the least doc_id and counts), so a text of a third of all rows is a row a task.
2. The state of a text, keyed by its digest, is the least doc_id so far and who has it. A smaller one takes its place: the earlier holders' masks
   are retracted from the counters and come back with the copy's bit. The output of a batch is changes of counters, appended to a table.
   The state store keeps the texts of a shard (a range of digests, one for every megabyte of files) in one row, as a call for each text costs
   milliseconds.
3. When no files are left, the changes add up to the counters, whatever the order of the files and the cut into micro-batches.
4. From at most 32 masks a part come the 80 pairs of a filter and the set of filters before it, and from them 120 orders of 5 steps.

The stream's checkpoint is in the shared folder, so a run cut short goes on after its last batch if given the same folder. The state store is
the session's choice; for more texts than executors can hold in memory choose RocksDB (``spark.sql.streaming.stateStore.providerClass``).

Defined results: a null text counts as empty, a null source as the empty part; a null doc_id is no copy and makes none, and has no labels; rows of one
doc_id and text are no copies of each other; of several labels of a doc_id the largest counts, none or a null is 0; very long texts
are read whole; an empty table gives no rows; other columns play no part. Texts are told apart by SHA-256.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.llm.common import bounded_batches, forget, shared_folder, small_side, table, written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a task holds while it puts copies together.
HELD = 100_000
#: Bytes of files for a shard of the state.
SHARD_BYTES = 1 << 20
#: A micro-batch has at least so many bytes of files, and there are at most so many micro-batches (and one).
BATCH_BYTES, BATCHES = 64 << 20, 64

_PARTIAL = pa.schema([
    ("digest", pa.binary()), ("mask", pa.int32()), ("part", pa.string()), ("flags", pa.int32()),
    ("least", pa.int64()), ("n_least", pa.int64()), ("n_more", pa.int64()), ("n_null", pa.int64()),
])
PARTIAL = "digest binary, mask int, part string, flags int, least long, n_least long, n_more long, n_null long"
CHANGES = "part string, mask int, flags int, change long"
STATE = "texts binary"


def text_mask(text: Column, words: Column) -> Column:
    """The bits of the filters that look at one text: few words, repeated words, capitals, marks."""
    n = F.size(words)
    fails = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def _masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(digest, mask, part, flags, doc_id) of every document."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.expr("max(coalesce(cast(quality = 1 as int), 0)) + 2 * max(coalesce(cast(toxic = 1 as int), 0))").alias("flags")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), text_mask(F.col("text"), F.col("words")).alias("mask")
    )
    # Null ids are dealt out by their digests; the second condition keeps them without labels.
    place = F.coalesce("doc_id", F.xxhash64("digest"))
    joined = rows.join(small_side(known), (place == F.col("label_id")) & F.col("doc_id").isNotNull(), "left")
    return joined.select("digest", "mask", "part", F.coalesce("flags", F.lit(0)).alias("flags"), "doc_id")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies in a task as one row: the least doc_id, how many have it, how many have a larger one and how many none."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        # Without any doc_id the least one is 0, held by none: a column without nulls keeps its integers in pandas.
        rows = [(*key, counts[0] or 0, *counts[1:]) for key, counts in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTIAL.types, strict=True)], schema=_PARTIAL)

    for batch in batches:
        for *key, doc in zip(*(batch.column(c).to_pylist() for c in ("digest", "mask", "part", "flags", "doc_id")), strict=True):
            counts = held.setdefault(tuple(key), [None, 0, 0, 0])
            if doc is None:
                counts[3] += 1
            elif counts[0] is None or doc < counts[0]:
                counts[:3] = [doc, 1, counts[1] + counts[2]]
            else:
                counts[1 if doc == counts[0] else 2] += 1
        if len(held) >= HELD:
            yield out()
    if held:
        yield out()


def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One shard in one micro-batch: the states of its texts, and the changes of counters."""
    texts: dict[bytes, tuple] = pickle.loads(state.get[0]) if state.exists else {}
    changes: dict[tuple, int] = {}

    def count(part: str, mask: int, flags: int, n: int) -> None:
        changes[part, mask, flags] = changes.get((part, mask, flags), 0) + n

    for frame in frames:
        for digest, mask, part, flags, low, n_least, n_more, n_null in zip(*(frame[c].tolist() for c in _PARTIAL.names), strict=True):
            count(part, mask, flags, n_null)
            count(part, mask | COPY, flags, n_more)
            if not n_least:
                continue
            least, holders = texts.get(digest, (None, {}))
            if least is None or low < least:
                for (p, f), n in holders.items():
                    count(p, mask, f, -n)
                    count(p, mask | COPY, f, n)
                least, holders = int(low), {}
                texts[digest] = least, holders
            if low == least:
                holders[part, flags] = holders.get((part, flags), 0) + n_least
                count(part, mask, flags, n_least)
            else:
                count(part, mask | COPY, flags, n_least)
    state.update((pickle.dumps(texts),))
    yield pd.DataFrame([(*at, n) for at, n in changes.items() if n], columns=["part", "mask", "flags", "change"])


def changes(docs: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """Of a stream of documents, the stream of changes of the counters (part, mask, flags)."""
    partial = _masked(docs, labels).mapInArrow(_partial, PARTIAL).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return partial.groupBy("shard").applyInPandasWithState(fold, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def _source(spark: SparkSession, path: str) -> tuple[str, int]:
    """The path as a stream reads it (a single file is given as a pattern, as a plain path must be a folder), and its bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    total = files.getContentSummary(at).getLength()
    if files.getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"
    return path, total


def _shards(spark: SparkSession, home: str, total: int) -> int:
    """How many shards the state has: as many as it began with."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/shards")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.range(1).select(F.lit(max(1, total // SHARD_BYTES)).alias("n")).coalesce(1).write.parquet(f"{home}/shards")
    return spark.read.parquet(f"{home}/shards").first()[0]


def counters(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, files: int | None = None) -> DataFrame:
    """(part, mask, flags, n) over all files at ``path``, streamed in micro-batches of ``files`` files, by default of a share of their bytes.

    ``folder`` keeps the checkpoint and the changes for a later call over more files; without one, they are deleted. The state has as many shards as its first
    call's bytes ask for.
    """
    bounded_batches(spark)
    home = folder or f"{shared_folder(spark)}/quillspan-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    source, total = _source(spark, path)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream.option("maxBytesPerTrigger", max(BATCH_BYTES, -(-total // BATCHES)))
    out = changes(stream.parquet(source), labels, _shards(spark, home, total)).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    out.option("path", f"{home}/changes").option("checkpointLocation", f"{home}/checkpoint").start().awaitTermination()
    found = spark.read.schema(CHANGES).parquet(f"{home}/changes").groupBy("part", "mask", "flags").agg(F.sum("change").alias("n"))
    kept = written(found.filter("n != 0"))
    if folder is None:
        found.written_to = home
        forget(found)
    return kept


def _pairs() -> list[tuple[int, int]]:
    """Every filter's bit with the bits of every set of others."""
    bits = [1 << k for k in range(len(FILTERS))]
    return [(f, sum(before)) for f in bits for n in range(len(bits)) for before in combinations([b for b in bits if b != f], n)]


def report(counts: DataFrame) -> DataFrame:
    """What every filter keeps and removes in every order, of each part, from its counters (part, mask, flags, n)."""
    pairs = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(before).alias("before")) for f, before in _pairs()))
    rows = counts.select("part", "mask", "flags", "n", F.explode(pairs).alias("p")).select("part", "mask", "flags", "n", "p.*")
    total = lambda condition, value="n": F.expr(f"sum(if({condition}, {value}, 0L))")
    fails, earlier = "mask & f != 0", "mask & before != 0"
    removed = f"{fails} and not {earlier}"
    orders = factorial(len(FILTERS))
    sums = rows.groupBy("part", "f", "before").agg(
        total("mask & (f | before) = 0").alias("kept"),
        total(removed).alias("removed"),
        total(f"{fails} and {earlier}").alias("redundant"),
        total("mask = f").alias("unique_fails"),
        total(f"{removed} and flags & 1 != 0").alias("good_lost"),
        total(f"{removed} and flags & 2 != 0").alias("toxic_lost"),
        # Each of a document's failing filters comes first among them in the same share of the orders.
        total(fails, f"n * ({orders} div bit_count(mask))").alias("shapley"),
    )
    bit = {c: 1 << k for k, c in enumerate(FILTERS)}
    steps = [("".join(o), k + 1, bit[o[k]], sum(bit[c] for c in o[:k])) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    steps = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sums.join(F.broadcast(steps), ["f", "before"]).select("part", "filter_order", "step", *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(counters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM texts LEFT JOIN known USING (doc_id)
), docs AS (
  SELECT part, quality, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failing FROM fails
), counts AS (
  SELECT part, failing, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM docs GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x != a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, k::INT AS step, filter_order[k] AS f, left(filter_order, k - 1) AS before FROM orders, unnest(range(1, 6)) AS t(k)
), acted AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(failing, f) AS fails, failing = f AS alone,
    length(failing) > length(translate(failing, before, '')) AS earlier FROM counts, steps
), sums AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM acted GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM sums
"""
