"""What the operators of this subpackage share: reading tables, staging results, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import ship
from siltstone.sources.staging import Staged, read, shared_dir

__all__ = ["Staged", "shared_dir", "stage", "table", "small", "fresh", "bounded_batches", "map_arrow", "split_words", "folded_words"]

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What stands between words (runs of ASCII letters and digits, after lower-casing A-Z, and of non-ASCII characters),
#: and between runs without ASCII white space.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    return Staged(df, label).df


def small(df: DataFrame, rows: int) -> DataFrame:
    """df (staged) with a broadcast hint if a count shows it to have at most `rows` rows; else a shuffle joins it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """names, each with as many underscores before it as set it apart from the names taken, whatever their case."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small however long the texts are. The settings hold for the session from here on, as they
    are read when a query runs, and change no result."""
    conf = ship(spark).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with batches that stay small however long the texts are."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def split_words(text: str, pattern: str) -> str:
    """SQL for the words between matches of pattern. Splitting is many times as fast as regexp_extract_all."""
    escaped = pattern.replace("\\", "\\\\")
    return f"array_remove(split({text}, '{escaped}'), '')"


def folded_words(column: str) -> str:
    return split_words(f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')", WORD_BREAK)
