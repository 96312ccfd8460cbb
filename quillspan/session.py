"""Session defaults for local work; a cluster brings its own."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Where the package lies, for Python workers on machines that share it; clusters ship it with --py-files.
ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession | None = None) -> None:
    """Let the Python workers of the session (by default the active one) import this package."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        environment = spark.sparkContext.environment
        if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, (environment.get("PYTHONPATH"), ROOT)))


def session(cores: str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session with UTC, AQE and as many shuffle partitions as asked for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspan")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in more.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
