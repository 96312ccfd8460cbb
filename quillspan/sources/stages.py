"""Staged jobs that may be cut short anywhere: artifacts by run, a manifest of what is done, joins for the work that is left.

A stage's rows lie under ``home/<stage>/run=<n>``, what is done under ``home/manifest/run=<n>``. A run's artifact is written first and its manifest
after it; a run without a manifest is never read. So a job's rows of a stage are those of the last run that the manifest names for it, and
a stage has as many folders as runs, not as jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "job_id string, stage string, fingerprint string, removed boolean, run long"


@dataclass(frozen=True)
class Stage:
    """``make`` turns rows of some jobs into the stage's rows of these jobs; both have ``job_id``. A new ``version`` does all jobs again."""

    name: str
    make: Callable[[DataFrame], DataFrame]
    version: str = "1"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, folder: str) -> list[int]:
    at, files = _files(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))


def _next(spark: SparkSession, home: str, *stages: str) -> int:
    return 1 + max((n for s in ("manifest", *stages) for n in _runs(spark, f"{home}/{s}")), default=0)


def done(spark: SparkSession, home: str, stage: str | None = None) -> DataFrame:
    """(job_id, stage, fingerprint, run): what the manifest last says of each job and stage, without what was removed."""
    if not _runs(spark, f"{home}/manifest"):
        return spark.createDataFrame([], MANIFEST).drop("removed")
    rows = spark.read.schema(MANIFEST).parquet(f"{home}/manifest")
    rows = rows if stage is None else rows.filter(F.col("stage") == stage)
    last = rows.groupBy("job_id", "stage").agg(F.max(F.struct("run", "fingerprint", "removed")).alias("_l"))
    return last.filter("not _l.removed").select("job_id", "stage", "_l.fingerprint", "_l.run")


def artifact(spark: SparkSession, home: str, stage: str, jobs: DataFrame | None = None) -> DataFrame:
    """A stage's rows of all jobs that have it done, or of those among ``jobs`` (job_id): one semi-join of the rows either way."""
    rows = spark.read.option("basePath", f"{home}/{stage}").parquet(*(f"{home}/{stage}/run={n}" for n in _runs(spark, f"{home}/{stage}")))
    rows = rows.withColumn("run", F.col("run").cast("long"))
    live = done(spark, home, stage).select("job_id", "run")
    live = live if jobs is None else live.join(jobs, "job_id", "left_semi")
    return rows.join(live, ["job_id", "run"], "left_semi").drop("run")


def fingerprints(inputs: DataFrame) -> DataFrame:
    """(job_id, fingerprint) of a job's rows, in whatever order; hashes are added up before the shuffle."""
    columns = sorted(c for c in inputs.columns if c != "job_id")
    # Which values are null is hashed with the values, as a hash skips nulls.
    row = lambda seed: F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
    sums = [F.sum(row(seed).cast("decimal(38,0)")).cast("string") for seed in ("a", "b")]
    return inputs.groupBy("job_id").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("fingerprint"))


def run(inputs: DataFrame, stages: list[Stage], home: str) -> DataFrame:
    """The last stage's rows of the jobs in ``inputs``; only what the manifest lacks is computed, stage by stage.

    A job is done again from the first stage on if its rows change, and from a stage on if that stage's version does.
    """
    spark = inputs.sparkSession
    prints, of = fingerprints(inputs), lambda jobs: inputs.join(jobs, "job_id", "left_semi")
    for stage in stages:
        prints = prints.select("job_id", F.sha2(F.concat_ws("|", F.lit(stage.name), F.lit(stage.version), "fingerprint"), 256).alias("fingerprint"))
        left = prints.join(done(spark, home, stage.name).select("job_id", "fingerprint"), ["job_id", "fingerprint"], "left_anti")
        if not left.isEmpty():
            n = _next(spark, home, *(s.name for s in stages))
            stage.make(of(left.select("job_id"))).write.parquet(f"{home}/{stage.name}/run={n}")
            left.select("job_id", F.lit(stage.name).alias("stage"), "fingerprint", F.lit(False).alias("removed")).write.parquet(f"{home}/manifest/run={n}")
        of = lambda jobs, name=stage.name: artifact(spark, home, name, jobs)
    return of(prints.select("job_id"))


def remove(spark: SparkSession, home: str, prefix: str) -> None:
    """Takes every stage of the jobs whose ids begin with ``prefix`` out of the manifest: one more run of it, nothing is rewritten."""
    gone = done(spark, home).filter(F.col("job_id").startswith(prefix))
    n = _next(spark, home, *gone.select("stage").distinct().toPandas()["stage"])
    gone.select("job_id", "stage", "fingerprint", F.lit(True).alias("removed")).write.parquet(f"{home}/manifest/run={n}")


def vacuum(spark: SparkSession, home: str, stages: list[str]) -> None:
    """Deletes the rows that no job has any more: removed jobs, earlier versions and runs cut short.

    A run's remaining rows are written beside it and take its place by a rename; a call cut short is finished by the next one.
    """
    for stage in stages:
        at, files = _files(spark, f"{home}/{stage}")
        path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(at, name)  # noqa: B023, E731
        for name in [s.getPath().getName() for s in files.listStatus(at)]:
            if name.startswith("_kept-"):  # written whole by a call cut short, if its marker is there
                own = path(name.removeprefix("_kept-"))
                if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path(name), "_SUCCESS")) and not files.exists(own):
                    files.rename(path(name), own)
                else:
                    files.delete(path(name), True)
        live = done(spark, home, stage)
        for n in _runs(spark, f"{home}/{stage}"):
            rows = spark.read.parquet(f"{home}/{stage}/run={n}")
            kept = rows.join(live.filter(F.col("run") == n).select("job_id"), "job_id", "left_semi")
            if rows.join(live.filter(F.col("run") == n).select("job_id"), "job_id", "left_anti").isEmpty():
                continue
            kept.write.mode("overwrite").parquet(f"{home}/{stage}/_kept-run={n}")
            files.delete(path(f"run={n}"), True)
            files.rename(path(f"_kept-run={n}"), path(f"run={n}"))
