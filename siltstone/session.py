"""Python workers find the package where the driver found it, whatever folder they start in."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the path of Python workers started from here on.

    On a cluster whose nodes do not share that folder, ship the package with --py-files; the entry is then idle.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shipped(df: DataFrame) -> DataFrame:
    """df, after ship: for operators about to send Python code."""
    ship(df.sparkSession)
    return df


def bounded(spark: SparkSession, rows: int, size: int) -> SparkSession:
    """spark, whose Arrow batches hold at most that many rows and bytes from here on, or fewer if that was set; no result depends on it."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark
