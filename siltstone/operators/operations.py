"""Ledgers, budgets, usage, rate limits and event tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import shipped
from siltstone.sources.staging import Staged


def balances(users: DataFrame, ledger: DataFrame) -> DataFrame:
    """user_id, balance: the sum of a user's amounts, 0 without any."""
    summed = ledger.groupBy("user_id").agg(F.sum("amount").alias("s"))
    return users.select("user_id").join(summed, "user_id", "left").select("user_id", F.coalesce("s", F.lit(0)).alias("balance"))


def latest(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The first n rows in order, of all rows or of each group."""
    if not by:
        return rows.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def active_counts(jobs: DataFrame, owner: str) -> DataFrame:
    """owner, active: how many of an owner's jobs wait or run; 0 where all are done."""
    return jobs.groupBy(owner).agg(F.count_if(F.col("status").isin("pending", "running")).alias("active"))


def pending(jobs: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The first n waiting jobs of each queue (by) with their place from 1: oldest first, then by job_id. Of each queue no more than n a task are shuffled."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("created_at", "job_id"))
    return jobs.where(F.col("status") == "pending").withColumn("place", place).where(F.col("place") <= n)


def user_list(accounts: DataFrame, subscriptions: DataFrame, ledger: DataFrame, n: int = 100) -> DataFrame:
    """Newest accounts with subscription_status (or none) and balance."""
    status = subscriptions.select("user_id", F.col("status").alias("subscription_status"))
    summed = ledger.groupBy("user_id").agg(F.sum("amount").alias("balance"))
    rows = accounts.join(status, "user_id", "left").join(summed, "user_id", "left")
    rows = rows.withColumns({"subscription_status": F.coalesce("subscription_status", F.lit("none")), "balance": F.coalesce("balance", F.lit(0))})
    return latest(rows, [F.desc("created_at"), F.asc("user_id")], max(1, min(n, 200)))


def committed(reservations: DataFrame) -> DataFrame:
    """budget_day, committed: actual cost of settled and reserved cost of open reservations."""
    cost = F.when(F.col("status") == "settled", F.col("actual_cost_usd")).when(F.col("status") == "reserved", F.col("reserved_cost_usd")).otherwise(0.0)
    return reservations.groupBy("budget_day").agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("committed"))


def admit_budget(requests: DataFrame, daily: float, reservation: float) -> DataFrame:
    """requests: day, ord, analysis_id. Which get a reservation: a repeated analysis shares its first, and as many fit as the day holds."""
    first = requests.groupBy("day", "analysis_id").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("ord"))
    decided = first.withColumn("admitted", place * reservation <= daily + 1e-12).drop("ord")
    return requests.join(decided, ["day", "analysis_id"])


def priced(usage: DataFrame, per_million_in: float, per_million_out: float) -> DataFrame:
    """usage with cost: its own, else from tokens if both are known, else null."""
    cost = (F.col("input_tokens") * per_million_in + F.col("output_tokens") * per_million_out) / 1_000_000
    return usage.withColumn("cost_usd", F.coalesce("cost_usd", cost))


def query_cost(usage: DataFrame, reservation: float) -> DataFrame:
    """analysis_id, cost: the sum if every record is priced, else the reservation."""
    return usage.groupBy("analysis_id").agg(
        F.when(F.bool_and(F.col("cost_usd").isNotNull()), F.sum("cost_usd")).otherwise(F.lit(reservation)).alias("cost")
    )


def daily_usage(usage: DataFrame) -> DataFrame:
    """By day: requests, sums that are null where nothing is known, and records with unknown tokens."""
    known = lambda c: F.when(F.count(c) > 0, F.sum(c)).alias(c)
    return usage.groupBy(F.to_date("occurred_at").alias("day")).agg(
        F.count(F.lit(1)).alias("request_count"), known("input_tokens"), known("output_tokens"), known("cost_usd"),
        F.count_if(F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).alias("unavailable_count"),
    )


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def metric_rollup(results: DataFrame, column: str) -> DataFrame:
    """name, total of the numeric leaves of a JSON object in each row; rows that are no object count for nothing."""
    parsed = results.select(F.from_json(column, "map<string,string>").alias("m"))
    leaf = parsed.select(F.explode("m").alias("name", "v")).withColumn("v", F.expr("try_cast(v as double)")).where("v is not null")
    return leaf.groupBy("name").agg(F.sum("v").alias("total"))


def upsert_latest(events: DataFrame, key: list[str], created: str = "event_created", arrival: str = "arrival") -> DataFrame:
    """The state per key: the event created last; of equal ones the last to arrive."""
    w = Window.partitionBy(*key).orderBy(F.desc(created), F.desc(arrival))
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def idempotent(rows: DataFrame, keys: list[list[str]], arrival: str = "arrival") -> DataFrame:
    """Rows that inserts in order of arrival (unique) accept under several unique keys; a key with a null part binds nothing.

    A row is refused if an accepted one before it has one of its keys; a refused row blocks nothing. With one key the first arrival of each is
    accepted. With more, each round accepts the rows that come first of all undecided ones in every key they have, and refuses those that share a key with them.
    """
    whole = lambda key: F.expr(" and ".join(f"{k} is not null" for k in key))
    if len(keys) == 1:
        w = Window.partitionBy(*keys[0]).orderBy(arrival)
        place = F.when(whole(keys[0]), F.row_number().over(w)).otherwise(1)
        return rows.withColumn("_u", place).where("_u = 1").drop("_u")
    names = [F.when(whole(key), F.concat(F.lit(f"{i}|"), F.to_json(F.struct(*key)))) for i, key in enumerate(keys)]
    held = rows.select(F.col(arrival).alias("_a"), F.filter(F.array(*names), lambda k: k.isNotNull()).alias("_k"))
    free = held.where(F.size("_k") == 0).select("_a")
    open_ = Staged(held.where(F.size("_k") > 0).select("_a", F.explode("_k").alias("_k"), F.size("_k").alias("_n")), "undecided").df
    accepted = [free]
    while not open_.isEmpty():
        first = open_.groupBy("_k").agg(F.min("_a").alias("_a"))
        taken = Staged(open_.join(first, ["_k", "_a"]).groupBy("_a", "_n").agg(F.count(F.lit(1)).alias("_c")).where("_c = _n").select("_a"), "accepted").df
        accepted.append(taken)
        spent = open_.join(taken, "_a", "left_semi").select("_k").distinct()
        refused = open_.join(spent, "_k", "left_semi").select("_a").distinct()
        open_ = Staged(open_.join(refused, "_a", "left_anti"), "undecided").df
    return rows.join(reduce(DataFrame.unionByName, accepted), F.col(arrival) == F.col("_a"), "left_semi")


def purge(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def admitted(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """events: key, ts, event_id. Which are admitted: fewer than `limit` admitted ones of the key lie in [ts - seconds, ts].

    Refused events do not count, so this is sequential per key: rows stream sorted by (key, ts, event_id) and only
    a key's admitted times of the window are held (`limit` at most). A hot key is one long stream, never one
    group in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, deque()
        for batch in batches:
            flags = []
            for k, at in zip(batch["key"], batch["ts"]):
                if k != key:
                    key, held = k, deque()
                while held and (at - held[0]).total_seconds() > seconds:
                    held.popleft()
                ok = len(held) < limit
                if ok:
                    held.append(at)
                flags.append(ok)
            yield batch.assign(admitted=flags)

    rows = shipped(events).select("key", "ts", "event_id").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", admitted boolean")
