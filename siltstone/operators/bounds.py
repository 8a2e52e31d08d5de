"""Exact nearest vectors by cosine, through blocks that bounds rule out.

Vectors gather around pivots. Of a block it is known how far its vectors lie from their pivot at most, and so what score none of them
can exceed for a query. A first pass scores each query against its most promising blocks; the k-th score found is a floor, and a second pass visits
the other blocks whose bound reaches it. Visits are products of matrices within tasks and return at most k rows a query and block,
so the product of queries and vectors is never rows. Results are those of scoring everything, whatever the bounds rule out.

Scores are rounded to DIGITS; equal ones go by identifier. Pivots are at most PIVOTS rows on the driver; a block is at most about BLOCK vectors,
and blocks asked by very many queries are copied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import shipped
from siltstone.sources.staging import Staged

DIGITS = 6
PIVOTS = 4096
BLOCK = 1024
#: Queries that one copy of a block serves, and that go through a product together.
QUERIES = 65_536
BATCH = 256
#: Rows of a batch sent on.
ROWS = 4096
#: What scores may be off by in double precision.
SLACK = 1e-9


@dataclass
class Blocks:
    """blocks: p, s, ids, values (unit vectors end to end); by pivot p its vector, radius, number of vectors and of blocks."""

    blocks: DataFrame | None
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    parts: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each unit row of q (or zero) and each pivot a score that no vector there exceeds."""
        near = q @ self.pivots.T
        # The scores of x and of its pivot differ by |x - pivot| at most, and from unit vectors a ball is no nearer than its centre less its radius.
        away = np.sqrt(np.maximum(0.0, 1.0 + (self.pivots**2).sum(axis=1) - 2 * near)) - self.radius
        unit = 1.0 - np.maximum(0.0, away) ** 2 / 2
        return np.minimum(near + self.radius, np.where(self.radius < 1.0, unit, 1.0)) + SLACK


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def gather(vectors: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> Blocks:
    """Blocks of vectors (id, vector), written once. Vectors that are null take no part; all others must be of one length."""
    rows = shipped(vectors).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high:
        raise ValueError("vectors differ in length")
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, math.isqrt(n)))).collect() if n else []
    # Copies of a vector are one pivot.
    centres = np.unique(_unit([r.vector for r in drawn]), axis=0) if drawn else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(1).to_pylist())
            near = x @ centres.T
            p = near.argmax(axis=1)
            # Nothing of a long vector's rounding may make a radius too small.
            away = np.sqrt(((x - centres[p]) ** 2).sum(axis=1)) + SLACK
            yield pa.record_batch({"p": pa.array(p, pa.int32()), "id": batch.column(0), "away": pa.array(away), "vector": pa.array(list(x), pa.list_(pa.float64()))})

    dealt = Staged(rows.mapInArrow(assign, "p int, id long, away double, vector array<double>"), "dealt").df
    known = dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    count, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in known:
        count[r.p], radius[r.p] = r.n, r.radius
    parts = -(-count // block)
    sizes = F.array(*[F.lit(int(x)) for x in parts]) if len(parts) else F.array(F.lit(1))
    numbered = dealt.withColumn("s", F.pmod(F.xxhash64("id"), sizes[F.col("p")]).cast("int"))
    grouped = numbered.groupBy("p", "s").agg(F.collect_list(F.struct("id", "vector")).alias("x"))
    made = Staged(grouped.select("p", "s", F.col("x.id").alias("ids"), F.flatten("x.vector").alias("values")), "blocks").df
    return Blocks(made, centres, radius, count, parts)


ASKED = "query_id long, q binary, floor double, p int, s int"


def _asker(made: Blocks, k: int, first: bool):
    """(query, floor, block) of the blocks to visit: first those that hold k vectors at least, in order of bound; then, with floors, all others that reach them."""
    made = replace(made, blocks=None)  # what tasks need of it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((b, i) for b in batches for i in range(0, b.num_rows, BATCH)):
            batch = whole.slice(at, BATCH)
            q = _unit(batch.column(1).to_pylist())
            bound = made.bounds(q)
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(made.count[order], axis=1) - made.count[order]
            opened = np.zeros(bound.shape, bool)
            np.put_along_axis(opened, order, before < k, axis=1)
            floor = np.array([-np.inf if f is None else f for f in batch.column(2).to_pylist()])
            wanted = opened if first else (bound >= floor[:, None] - 0.5 * 10.0**-DIGITS) & ~(opened if k else False)
            # A batch holds BATCH queries at most, each with a number for each block.
            at, p = np.nonzero(wanted & (made.count > 0))
            parts = made.parts[p]
            at, p = np.repeat(at, parts), np.repeat(p, parts)
            s = np.arange(len(p)) - np.repeat(np.cumsum(parts) - parts, parts)
            raw = [x.tobytes() for x in q]
            for i in range(0, len(at), ROWS):
                some = slice(i, i + ROWS)
                cells = [batch.column(0).take(pa.array(at[some])), pa.array([raw[x] for x in at[some]], pa.binary()), pa.array(floor[at[some]])]
                yield pa.record_batch([*cells, pa.array(p[some], pa.int32()), pa.array(s[some], pa.int32())], ["query_id", "q", "floor", "p", "s"])

    return run


def _visitor(k: int | None):
    """Scores of each block's vectors for the queries that follow it in the stream: those from the floor on, the first k of them unless k is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, held = None, None, []

        def answer() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            scores = np.round(np.frombuffer(b"".join(h[1] for h in held)).reshape(len(held), -1) @ x.T, DIGITS) + 0.0
            found = []
            for score, floor in zip(scores, [h[2] for h in held]):
                take = np.flatnonzero(score >= floor)
                if k is not None and len(take) > k:
                    take = take[np.lexsort((ids[take], -score[take]))[:k]]
                found.append(take)
            size = [len(f) for f in found]
            take, row = np.concatenate(found), np.repeat(np.arange(len(held)), size)
            yield pa.record_batch({"query_id": pa.array(np.array([h[0] for h in held])[row], pa.int64()), "id": pa.array(ids[take]), "score": pa.array(scores[row, take])})
            held.clear()

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, query in enumerate(columns["query_id"].to_pylist()):
                if query is None:
                    yield from answer()
                    ids = columns["ids"][i].values.to_numpy(zero_copy_only=False)
                    x = columns["values"][i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                else:
                    held.append((query, columns["q"][i].as_py(), columns["floor"][i].as_py()))
                    if len(held) >= BATCH:
                        yield from answer()
        yield from answer()

    return run


def _visited(made: Blocks, asked: DataFrame, k: int | None, groups: int) -> DataFrame:
    """query_id, id, score of the visits asked."""
    dealt = asked.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    blocks = made.blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    streams = blocks.unionByName(dealt, allowMissingColumns=True).repartition("p", "s", "g")
    streams = streams.sortWithinPartitions("p", "s", "g", F.col("query_id").asc_nulls_first())
    return streams.mapInArrow(_visitor(k), "query_id long, id long, score double")


def _queries(queries: DataFrame, made: Blocks) -> tuple[DataFrame, int]:
    """query_id, vector, floor (null where queries have none), written once; and copies of the blocks that they need."""
    floor = F.col("floor") if "floor" in queries.columns else F.lit(None)
    rows = shipped(queries).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), floor.cast("double").alias("floor"))
    q = Staged(rows.where("query_id is not null and vector is not null"), "asked").df
    n, low, high = q.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if n and made.pivots.size and not low == high == made.pivots.shape[1]:
        raise ValueError("vectors differ in length")
    return q, max(1, -(-n // QUERIES))


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(made: Blocks, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the k vectors with the largest cosine for each query (query_id, vector), written once.

    Cosines with a zero vector are 0. Queries with a null vector get no rows; fewer than k vectors give fewer rows. Identifiers are
    integers; a repeated query identifier asks once for all its vectors and should not occur.
    """
    q, groups = _queries(queries.select("query_id", "vector"), made)
    if not made.pivots.size:
        return q.selectExpr("query_id", "0 AS rank", "0L AS id", "0.0D AS score").limit(0)
    ask = lambda df, first: df.mapInArrow(_asker(made, k, first), ASKED)
    found = Staged(_best(_visited(made, ask(q, True), k, groups), k), "first").df
    floors = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("_f"))
    raised = q.join(floors, "query_id", "left").select("query_id", "vector", F.col("_f").alias("floor"))
    more = _visited(made, ask(raised, False), k, groups)
    return Staged(_best(found.select("query_id", "id", "score").unionByName(more), k).select("query_id", "rank", "id", "score"), "nearest").df


def within(made: Blocks, queries: DataFrame) -> DataFrame:
    """query_id, id, score of all vectors whose score reaches the query's floor (query_id, vector, floor)."""
    q, groups = _queries(queries, made)
    if not made.pivots.size:
        return q.selectExpr("query_id", "0L AS id", "0.0D AS score").limit(0)
    return _visited(made, q.mapInArrow(_asker(made, 0, False), ASKED), None, groups)


def both_ends(made: Blocks, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """nearest(), and query_id, id, score of the farthest vector of each query: the nearest of the opposite one, sought in the same passes."""
    signs = F.array(F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("x")), F.struct(F.lit(1).alias("i"), F.lit(-1.0).alias("x")))
    signed = queries.select("query_id", "vector", F.inline(signs))
    found = nearest(made, signed.select((F.col("query_id") * 2 + F.col("i")).alias("query_id"), F.transform("vector", lambda c: c.cast("double") * F.col("x")).alias("vector")), k)
    own = F.shiftright("query_id", 1).alias("query_id")
    near = found.where("query_id & 1 = 0").select(own, "rank", "id", "score")
    return near, found.where("query_id & 1 = 1 and rank = 1").select(own, "id", (F.lit(0.0) - F.col("score")).alias("score"))


def ruled_out(made: Blocks, queries: DataFrame, k: int) -> float:
    """Share of the pairs of queries and vectors that nearest() never scores."""
    q, _ = _queries(queries, made)
    best = nearest(made, queries, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_f"))
    raised = q.join(best, "query_id", "left").select("query_id", "vector", F.col("_f").alias("floor"))
    counts = F.array(*[F.lit(int(x)) for x in made.count])
    seen = [df.mapInArrow(_asker(made, k, first), ASKED).select("query_id", "p").distinct() for df, first in ((q, True), (raised, False))]
    scored = seen[0].unionByName(seen[1]).distinct().agg(F.sum(counts[F.col("p")])).first()[0]
    return 1 - (scored or 0) / max(1, q.count() * int(made.count.sum()))
