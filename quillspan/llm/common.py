"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_type

#: Where the package lies, for Python workers on machines that share it; clusters ship it with --py-files.
ROOT = str(Path(__file__).resolve().parents[2])

#: Rows and bytes of one Arrow batch between the JVM and a Python worker; whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

#: Rows that a lookup table may have to be broadcast (24 bytes a row or so: 24 MB).
BROADCAST_ROWS = 1_000_000


#: No bound on the length of a text.
MOST_CHARS = (1 << 31) - 1


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts, and let workers import this package.

    Results are lazy, so the session keeps these settings; a caller's smaller ones stay as they are.
    """
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (environment.get("PYTHONPATH"), ROOT)))
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        number = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if number is None or not 0 < int(number[1]) <= most:
            spark.conf.set(key, str(most))


def text_struct(setup: Callable[[], Callable[[list], list[list]]], schema: str) -> Callable[..., Column]:
    """An Arrow UDF from one column of values to a struct column.

    ``setup`` runs once a task and returns a function that takes the values of a batch
    (``None`` for null) and returns one list for each field of ``schema``.
    """
    kind = to_arrow_type(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = setup()
        for values in batches:
            columns = work(values.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not deterministic for the optimizer only: it then never evaluates the UDF twice.
    return F.arrow_udf(run, schema_type(schema)).asNondeterministic()


def schema_type(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def apply_struct(df: DataFrame, key: str, udf: Callable[..., Column], value: Column) -> DataFrame:
    """``key`` and the fields of ``udf(value)``; other columns are pruned, so none can clash."""
    return df.select(F.col(key), udf(value).alias("_r")).select(key, "_r.*")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it has few enough rows, else leave the join to Spark.

    ``rows`` is its row count where the caller knows it.
    """
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(
    docs: DataFrame, known: DataFrame, most: dict, max_chars: int, columns: list[Column] | None = None
) -> tuple[list[tuple], dict]:
    """A bounded sample of labelled rows, and the number of labels of each kind.

    ``known`` has doc_id and label; of several labels of one doc_id the largest counts. Of each label in ``most``
    about that many rows at most are picked by a hash of doc_id. Only the picked ids (a few thousand at most) are
    broadcast to the scan of ``docs``, of which only doc_id and text are read, whatever its other columns are called;
    texts of over ``max_chars`` characters are left out. Returns (label, *columns) rows, by default the text.
    """
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    shares = {label: int(min(1.0, n / max(counts.get(label, 0), 1)) * (1 << 30)) for label, n in most.items()}
    limit = F.create_map(*(F.lit(x) for share in shares.items() for x in share))[F.col("label")] if shares else F.lit(0)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    picked = texts.join(F.broadcast(known.filter(place < limit)), "doc_id").select("doc_id", "label", *(columns or [F.col("text")]))
    # By id and label, then by a digest of the rest: what is long is not held twice for the sake of its order.
    place = lambda r: (repr(r[:2]), hashlib.md5(repr(r[2:]).encode()).digest())
    rows = sorted(map(tuple, picked.collect()), key=place)
    return [r[1:] for r in rows], counts


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no frame has such a column (Spark's names know no case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``.

    Where it is unset, one under the warehouse serves a local session; on a cluster that folder might be each
    machine's own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and a lost executor loses none of it.

    ``forget`` deletes it; a table that a returned DataFrame still reads stays until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/quillspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
