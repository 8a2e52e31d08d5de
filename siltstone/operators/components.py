"""Connected components of a distributed edge list by alternating large-star and small-star rounds.

Each round is a fixed number of aggregations and joins over the edges; its result is written to the
shared folder, so lineage stays short and a lost executor recomputes one round at most. Edges never
reach the driver, which reads one row of counts a round. A node with very many edges (the hub of a star) is a
hot key of the joins by node; adaptive execution splits it there, and the aggregates by node combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.staging import Staged, sized

#: Rounds grow with the logarithm of the longest path; far more than any input needs.
MAX_ROUNDS = 60


def _star(edges: DataFrame, n: int) -> DataFrame:
    """u > v in every row (n of them); one large-star and one small-star step."""
    small = lambda df: sized(df, 2 * n)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = small(small(large.where(F.col("u") != F.col("v"))).distinct())
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = small(large.join(low, "u"))
    further = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small(further.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns u, root for every node with an edge to another; root is its component's least node.

    Self-loops and repeated edges change nothing; null ends are ignored; no edges give no rows.
    """
    rows = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = Staged(rows.distinct(), "edges")
    mark = _mark(now.df)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        after = Staged(_star(now.df, mark[0]), "edges")
        new = _mark(after.df)
        now.drop()
        now, done, mark = after, new == mark, new
        if done:
            break
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    roots = now.df.select("v").distinct()
    return now.df.select("u", F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("u"), F.col("v").alias("root")))
