"""Unbounded forms: rate limits, late payment events, idempotent processing, caches, job states, early stop.

Each takes a streaming DataFrame (or a batch one, for the same result over what is there).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.session import shipped

RATE_OUT = "key string, event_id long, ts timestamp, admitted boolean"

#: Legal moves of a job.
TRANSITIONS = (("pending", "running"), ("running", "completed"), ("running", "failed"), ("pending", "failed"))


def rate_limit(events: DataFrame, limit: int, seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """events: key, event_id, ts. Admitted are events with fewer than `limit` admitted ones in the window before them.

    State is a key's admitted times of the last window, `limit` at most, and goes when the window has passed the watermark.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        flags = []
        for at in rows["ts"]:
            now = at.timestamp()
            held = [h for h in held if now - h <= seconds]
            flags.append(len(held) < limit)
            if flags[-1]:
                held.append(now)
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(int((max(held) + seconds) * 1000) + 1)
        yield rows.assign(key=key[0], admitted=flags)[["key", "event_id", "ts", "admitted"]]

    rows = shipped(events).select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return rows.groupBy("key").applyInPandasWithState(run, RATE_OUT, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


TTL_OUT = "key string, event_id long, ts timestamp, hit boolean, value string"


def ttl_cache(events: DataFrame, ttl: float, lateness: str = "10 minutes") -> DataFrame:
    """events: key, event_id, ts, kind (`put` or `get`), value. One row per get: the value put last, if that is less than `ttl` seconds ago.

    State is a key's newest value and when it was put; it goes when that has expired before the watermark. Events of a key are taken in order of time,
    a put before a get of the same time, within each micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).assign(late=lambda d: d["kind"] != "put").sort_values(["ts", "late", "event_id"])
        out = []
        for r in rows.itertuples():
            now = r.ts.timestamp()
            if r.kind == "put":
                if at is None or now >= at:
                    value, at = r.value, now
            else:
                hit = at is not None and now - at < ttl
                out.append((key[0], r.event_id, r.ts, hit, value if hit else None))
        if at is not None:
            state.update((value, at))
            state.setTimeoutTimestamp(max(int((at + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "hit", "value"])

    rows = shipped(events).select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "value").withWatermark("ts", lateness)
    return rows.groupBy("key").applyInPandasWithState(run, TTL_OUT, "value string, at double", "append", GroupStateTimeout.EventTimeTimeout)


def once(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Events processed once: repetitions of the keys within the lateness are dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def latest_state(events: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The values of each key's event created last; arrival breaks ties. events: key..., event_created, arrival, values..."""
    at = F.struct("event_created", "arrival")
    return events.groupBy(*key).agg(F.max("event_created").alias("event_created"), *[F.max_by(v, at).alias(v) for v in values])


def usage_by_window(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Requests and value of each type by tumbling window; windows close at the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def job_moves(moves: DataFrame, states: DataFrame) -> DataFrame:
    """The legal ones of a micro-batch's moves (job_id, to) given the states (job_id, state): for use in foreachBatch."""
    spark = moves.sparkSession
    legal = spark.createDataFrame(TRANSITIONS, "state string, to string")
    return moves.join(states, "job_id").join(F.broadcast(legal), ["state", "to"], "left_semi").select("job_id", "state", "to")


def recover(states: DataFrame) -> DataFrame:
    """After a crash: running jobs are failed, pending ones wait."""
    return states.withColumn("state", F.when(F.col("state") == "running", "failed").otherwise(F.col("state")))
