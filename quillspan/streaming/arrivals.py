"""Files dropped into a folder: the last to arrive takes a slot that holds one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SLOT = "path string, modificationTime timestamp, length long, content binary"


def _arrivals(spark: SparkSession, slot: str) -> list[tuple[int, object]]:
    """The slot's versions by the micro-batch that wrote them, complete ones only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(slot)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(files.listStatus(at)) if files.exists(at) else []
    done = [s.getPath() for s in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted((int(p.getName().split("=")[1]), p) for p in done)


def _overwrite(slot: str):
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The last of the batch is picked without the contents, which are read for that one file only.
        last = batch.agg(F.max(F.struct("modificationTime", "path"))).first()[0]
        if last is None:
            return
        batch.filter((F.col("path") == last.path) & (F.col("modificationTime") == last.modificationTime)).limit(1).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{slot}/arrival={number}")
        for earlier, path in _arrivals(spark, slot):
            if earlier < number:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return put


def watch(spark: SparkSession, folder: str, slot: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Takes what has arrived in ``folder`` since the last call (by ``checkpoint``); the last file overwrites the slot.

    Of one micro-batch the newest file counts, of equal times the larger path; a later micro-batch overwrites an earlier one. A version
    is written whole before the one before it is deleted, and a micro-batch that is repeated after a failure writes the same version
    again, so the slot never has less or more than one file once a first one came.
    """
    stream = spark.readStream.format("binaryFile").schema(SLOT)
    stream = stream if files is None else stream.option("maxFilesPerTrigger", files)
    return stream.load(folder).writeStream.foreachBatch(_overwrite(slot)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held(spark: SparkSession, slot: str) -> DataFrame:
    """The file in the slot: path, modificationTime, length, content; no row before the first arrival."""
    versions = _arrivals(spark, slot)
    return spark.read.schema(SLOT).parquet(versions[-1][1].toString()) if versions else spark.createDataFrame([], SLOT)
