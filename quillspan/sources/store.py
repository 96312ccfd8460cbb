"""Tables of jobs and artifacts: upsert, cascade delete, append-only logs, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, job: str = "job_id") -> None:
    """Replaces the partitions of the jobs that ``df`` has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(path)


def load(spark: SparkSession, path: str, job_id: str | None = None, job: str = "job_id") -> DataFrame:
    """One job's rows (only its partition is read) or all."""
    rows = spark.read.parquet(path)
    return rows if job_id is None else rows.filter(F.col(job) == job_id)


def remove(spark: SparkSession, paths: list[str], job_id: str, job: str = "job_id") -> None:
    """Drops a job's partition from every artifact table, through Hadoop's file system."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{job}={job_id}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; a local session may do without and has one under its warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the folder of ``spark.checkpoint.dir``, for plans that read it several times.

    Where the setting is absent, a local session uses a folder under its warehouse; on a cluster that is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def newest_first(rows: DataFrame, at: str, most: int | None = None) -> DataFrame:
    """Rows by time, newest first; the newest ``most`` if given (a limit that Spark pushes into its tasks)."""
    ordered = rows.orderBy(F.desc(at))
    return ordered if most is None else ordered.limit(most)


def append_log(rows: DataFrame, path: str, detail: str = "detail", limit: int = 300) -> None:
    """Adds rows to a log, with details cut to ``limit`` characters; ``newest_first`` of 200 is what a screen shows."""
    rows.withColumn(detail, F.substring(detail, 1, limit)).write.mode("append").parquet(path)


def latest(rows: DataFrame, keys: list[str], at: str, n: int = 1) -> DataFrame:
    """The ``n`` newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
