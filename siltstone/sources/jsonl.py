"""JSON-lines data sets: a header row, one record a line, errors by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 within a file), value of non-blank lines. Each file is a data set of its own.

    Large files are read in splits: a line's number is its place in its split after the lines of the splits before, of which only counts are shuffled.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value"
    )
    splits = rows.groupBy("file", "at").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("file").alias("f"), F.col("at").alias("a"), "low", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.join(splits, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")))
    return placed.where(F.trim("value") != "").select("file", (F.col("i") - F.col("low") + F.col("before") + 1).alias("line"), "value")


def load(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors). Records carry the schema's columns and line; a `_meta` row is left out.

    Errors are line and reason: `malformed`, `missing key`, or `duplicate key` (from the second on).
    """
    rows = read_lines(spark, path).where(~F.col("value").rlike(r'^\s*\{\s*"_meta"'))
    parsed = rows.select("file", "line", "value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull() | ~F.trim("value").startswith("{")
    nth = F.row_number().over(Window.partitionBy("file", F.col(f"r.{key}")).orderBy("line"))
    reason = F.when(bad, "malformed").when(F.col(f"r.{key}").isNull(), "missing key").when(nth > 1, "duplicate key")
    marked = parsed.withColumn("reason", reason)
    names = [f"r.{f.name}" for f in spark.createDataFrame([], schema).schema]
    return marked.where("reason is null").select("line", *names), marked.where("reason is not null").select("line", "reason")


def meta(spark: SparkSession, path: str) -> DataFrame:
    """The header rows of the data sets, as JSON text."""
    return read_lines(spark, path).where(F.col("value").rlike(r'^\s*\{\s*"_meta"')).select("file", "value")


def write(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls included."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
