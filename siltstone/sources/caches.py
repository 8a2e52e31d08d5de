"""Keyed caches as tables: freshness, misses, latest entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as t


def key(*parts: Column) -> Column:
    """SHA-256 of the parts as one JSON array."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def request_key(version: int, provider: Column, query: Column, mode: Column, limit: Column) -> Column:
    return key(F.lit(version), t.casefold(provider), t.casefold(t.collapse(query)), mode, limit)


def _seconds(at: Column) -> Column:
    return at.cast("timestamp").cast("double")


def latest(entries: DataFrame, keys: list[str], at: str = "stored_at") -> DataFrame:
    """The newest entry of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fresh(entries: DataFrame, now: Column, ttl_seconds: float, at: str = "stored_at") -> DataFrame:
    """Entries younger than the time to live."""
    return entries.where(_seconds(now) - _seconds(F.col(at)) < ttl_seconds)


def fresh_documents(entries: DataFrame, now: Column, negative_ttl_seconds: float) -> DataFrame:
    """Usable documents never expire; failures do."""
    return entries.where((F.col("status") == "usable") | (_seconds(now) - _seconds(F.col("stored_at")) <= negative_ttl_seconds))


def upsert(entries: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return latest(entries.unionByName(incoming), keys)


def delete(entries: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return entries.join(gone.select(*keys).distinct(), keys, "left_anti")


def misses(needed: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """What is needed and not there, each key once."""
    return needed.dropDuplicates(keys).join(entries.select(*keys), keys, "left_anti")


def hits(needed: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    return needed.join(entries, keys)
