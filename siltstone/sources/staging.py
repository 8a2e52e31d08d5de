"""Intermediate results written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.session import ship


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode takes a temporary folder of its own; a cluster is told to set it, as
    no folder of one machine is seen by the others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has staged; results not yet read are lost with it."""
    remove(spark, own_dir(spark))


#: Bytes of a file for each task that reads it, where it would have fewer tasks than there are cores.
SPREAD_BYTES = 1 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at path. One whose row groups are fewer than cores is dealt anew, so that what follows uses all of them.

    Only tables that a few splits hold are, so at most so many splits are shuffled; columns and filters are still pushed to the scan.
    """
    df = ship(spark).read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    wanted = min(cores, size // SPREAD_BYTES)
    return df.repartition(wanted) if wanted > 1 and df.rdd.getNumPartitions() <= wanted // 2 else df


#: Bytes of a file for each partition of rows made of it, which grow to several times that once they are decoded.
PART_BYTES = 4 << 20


def dealt(df: DataFrame, by: str, path: str) -> DataFrame:
    """df, made of the rows of the table at path, shuffled by a column into partitions whose number grows with the table.

    What groups, counts or sorts out the rows of one `by` then needs no other shuffle, and holds a bounded part in memory.
    """
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.repartition(max(1 + min(spark.sparkContext.defaultParallelism, size // SPREAD_BYTES), size // PART_BYTES), by)


def sized(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df, of about `rows` rows, in as many partitions as give each of them that many rows; never in more than it has by default.

    Iterations over what has become small then do not start a task for every shuffle partition of the session.
    """
    parts = 1 + rows // each
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


class Staged:
    """A DataFrame as a Parquet folder; reading it does not depend on what made it."""

    def __init__(self, df: DataFrame, label: str):
        self._spark = ship(df.sparkSession)
        self.path = f"{own_dir(self._spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self._spark, self.path)
