"""Nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

Equal vectors fold into one node, which keeps as many of its smallest identifiers as any query can
need. Nodes are dealt to shards by bands of length, and within a band by a hash. A shard's graph is a set of flat arrays:
nodes are numbered from the highest level down, so level l holds nodes 0 to n[l] - 1 and its neighbours
are one int32 matrix, unused places -1. Inner product becomes a metric by one more component,
sqrt(max |x|^2 - |x|^2), which makes all vectors equally long; queries get 0 there. The maximum is the shard's own, so in a band
that component is small and queries lie near the nodes they look for.

Graphs are built and searched for many vectors at once: a batch searches the graph so far (and
itself), chooses diverse neighbours, and links back. Searching, each shard's
arrays stream before its queries, so a task holds one shard and one batch. Results carry exact
inner products in double precision of the original vectors; shards merge by score, then identifier.

Every query visits every shard, so shards grow with the table: SHARD nodes up to GROW_FROM of them, then with the root of
their number, up to SHARD_BYTES of vectors. The width of the beam grows with the root of a shard's nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm._common import map_arrow, small, stage

K = 20
#: Nodes a shard aims at, nodes of the table from which it grows, and bytes of vectors (as doubles) that it may have.
SHARD = 4_096
GROW_FROM = 1 << 16
SHARD_BYTES = 128 << 20
#: Bands of length: at most, and of a table of less than as many shards (then of DIRECT nodes at least).
BANDS = 64
FEW_BANDS = 4
#: Marks (a query and a node, 5 bytes each) that a search may hold.
MARKS = 1 << 24
#: Rows of shard numbers or bands (8 to 40 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Neighbours a node keeps on upper levels (twice as many on level 0), nearest nodes they are chosen from, and the widths of the beams that
#: find them and that answer queries (the latter in a shard of SHARD nodes; it grows with the root of a shard's nodes).
M = 16
CANDIDATES = 48
EF_BUILD = 48
EF_SEARCH = 128
#: Vectors inserted or searched together, nodes that are linked without searching, nodes below which a search is a scan.
BATCH = 256
DIRECT = 1024
SCAN = 256
#: Queries that one copy of a shard's arrays serves.
QUERIES = 65_536
#: A shard number is dimension * SPAN + number within the dimension.
SPAN = 1 << 24


def _levels(n: int) -> list[int]:
    """Nodes on each level, from 0 up: each level has a share of 1 / M of the one below."""
    sizes = [n]
    while sizes[-1] > M * 4:
        sizes.append(sizes[-1] // M)
    return sizes


def _beam(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest found of the graph's nodes for each row of q: ids (-1 where fewer) and similarities, best first.

    All rows of q go together, each expanding its best nodes not yet expanded, a step's worth at a time; only nodes new to a row are compared.
    """
    b, n, step = len(q), len(graph), max(4, ef // 16)
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    todo = np.zeros((b, ef), bool)
    seen = np.zeros(b * n, bool)
    mark = np.empty(b * n, np.int32)
    ids[:, 0], todo[:, 0] = entry, True
    sims[:, 0] = np.einsum("bd,bd->b", x[entry], q)
    seen[np.arange(b) * n + entry] = True
    live = np.arange(b)
    while True:
        best = np.where(todo[live], sims[live], -np.inf)
        place = np.argpartition(best, ef - step, axis=1)[:, ef - step :] if ef > step else np.broadcast_to(np.arange(ef), best.shape)
        ok = np.take_along_axis(todo[live], place, 1)
        some = ok.any(axis=1)
        live, place, ok = live[some], place[some], ok[some]
        if not len(live):
            break
        at, column = np.nonzero(ok)
        row, place = live[at], place[at, column]
        todo[row, place] = False
        near = graph[ids[row, place]]
        key = (row[:, None] * n + near)[near >= 0]
        key = key[~seen[key]]
        # A node that several expanded nodes lead to is kept where it stands last.
        number = np.arange(len(key), dtype=np.int32)
        mark[key] = number
        key = key[mark[key] == number]
        seen[key] = True
        row, node = np.divmod(key, n)
        s = np.einsum("fd,fd->f", x[node], q[row])
        better = s > sims.min(axis=1)[row]
        row, node, s = row[better], node[better], s[better]
        if not len(row):
            continue
        count = np.bincount(row, minlength=b)
        rows = np.flatnonzero(count)
        count = count[rows]
        line, place = np.repeat(np.arange(len(rows)), count), np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max())
        more_s, more_i = np.full((len(rows), width), -np.inf, np.float32), np.full((len(rows), width), -1, np.int64)
        more_s[line, place], more_i[line, place] = s, node
        all_s, all_i = np.hstack([sims[rows], more_s]), np.hstack([ids[rows], more_i])
        all_t = np.hstack([todo[rows], more_i >= 0])
        kept = np.argpartition(all_s, width, axis=1)[:, width:]
        sims[rows] = np.take_along_axis(all_s, kept, 1)
        ids[rows] = np.take_along_axis(all_i, kept, 1)
        todo[rows] = np.take_along_axis(all_t, kept, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) at most m: nearer to the row than to any chosen; then the best of the rest."""
    b, k = ids.shape
    v = x[np.maximum(ids, 0)]
    between = v @ v.transpose(0, 2, 1)
    valid = ids >= 0
    closest = np.full((b, k), -np.inf, np.float32)
    chosen = np.zeros((b, k), bool)
    count = np.zeros(b, np.int64)
    for j in range(k):
        take = valid[:, j] & (count < m) & (sims[:, j] > closest[:, j])
        if take.any():
            chosen[take, j] = True
            count[take] += 1
            closest[take] = np.maximum(closest[take], between[take, j])
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    found = np.take_along_axis(ids, order, 1)
    if found.shape[1] < m:
        found = np.pad(found, ((0, 0), (0, m - found.shape[1])), constant_values=-1)
    return found


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _link_back(x: np.ndarray, graph: np.ndarray, new: np.ndarray, near: np.ndarray) -> None:
    """Adds to each node of near[i] a link to new[i]; full nodes choose among old and new links."""
    width = graph.shape[1]
    target, source = near.ravel(), np.repeat(new, near.shape[1])
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    s = np.einsum("ad,ad->a", x[target], x[source])
    order = np.lexsort((-s, target))
    target, source = target[order], source[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(begin, count)
    keep = place < width
    row = np.repeat(np.arange(len(nodes)), count)[keep]
    extra = np.full((len(nodes), min(width, int(count.max()))), -1, np.int64)
    extra[row, place[keep]] = source[keep]
    for at in range(0, len(nodes), BATCH):
        part = nodes[at : at + BATCH]
        cand = np.hstack([graph[part].astype(np.int64), extra[at : at + BATCH]])
        room = (cand >= 0).sum(axis=1)
        sims = np.einsum("akd,ad->ak", x[np.maximum(cand, 0)], x[part]).astype(np.float32)
        sims[cand < 0] = -np.inf
        cand, sims = _top(cand, sims, int(room.max()))
        cand = np.where(np.isneginf(sims), -1, cand)
        full = room > width
        if cand.shape[1] < width:
            cand, sims = (np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=v) for a, v in ((cand, -1), (sims, -np.inf)))
        out = cand[:, :width].copy()
        if full.any():
            out[full] = _diverse(x, cand[full], sims[full], width)
        graph[part] = out


def _among(x: np.ndarray, new: np.ndarray, first: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the new nodes (consecutive) the k nearest of the nodes from first to the last new one, itself aside, best first."""
    end = int(new[-1]) + 1
    s = x[new] @ x[first:end].T
    s[np.arange(len(new)), new - first] = -np.inf
    k = min(k, end - first)
    ids = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < end - first else np.broadcast_to(np.arange(end - first), s.shape)
    ids, sims = _top(ids, np.take_along_axis(s, ids, 1), k)
    return np.where(np.isneginf(sims), -1, ids + first), sims


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour matrices of each level, from 0 up, over the rows of x (equally long, float32).

    Levels are built from the top down. A level's first DIRECT nodes find each other by products; from there on a batch of new nodes
    searches the graph so far, entering it by the levels above, and its own members by a product.
    """
    graphs: list[np.ndarray] = []
    for level, n in reversed(list(enumerate(_levels(len(x))))):
        graph = np.full((n, 2 * M if level == 0 else M), -1, np.int32)
        at, direct = 0, max(DIRECT, len(graphs[0]) if graphs else 0)
        while at < n:
            new = np.arange(at, min(n, at + min(_rows(at), max(64, at)), direct if at < direct else n))
            if at < direct:
                found = _among(x, new, 0, CANDIDATES)
            else:
                before = _beam(x, graph[:at], x[new], _descend(x, [graph, *graphs], x[new]), EF_BUILD)
                found = _top(*(np.hstack(both) for both in zip(before, _among(x, new, at, CANDIDATES))), CANDIDATES)
            near = _diverse(x, *found, M)
            graph[new, :M] = near
            _link_back(x, graph, new, near)
            at = int(new[-1]) + 1
        graphs.insert(0, graph)
    return graphs


def _descend(x: np.ndarray, graphs: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """An entry to level 0 for each row of q, by way of the levels above."""
    entry = np.zeros(len(q), np.int64)
    for graph in graphs[:0:-1]:
        entry = _beam(x, graph, q, entry, 4)[0][:, 0]
    return entry


def _rows(n: int) -> int:
    """Vectors that go together through a graph of n nodes."""
    return max(16, min(BATCH, MARKS // max(1, n)))


def beam_width(n: int) -> int:
    """Nearest nodes that a search of a graph of n nodes keeps: in a larger graph more nodes lie about as near as the nearest."""
    return max(EF_SEARCH, int(EF_SEARCH * math.sqrt(n / SHARD)))


def search(x: np.ndarray, graphs: list[np.ndarray], q: np.ndarray, ef: int | None = None) -> np.ndarray:
    """Nodes found near each row of q (-1 where fewer than ef)."""
    if len(x) <= SCAN:
        return np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
    rows = _rows(len(x))
    parts = [q[i : i + rows] for i in range(0, len(q), rows)]
    return np.vstack([_beam(x, graphs[0], part, _descend(x, graphs, part), ef or beam_width(len(x)))[0] for part in parts])


INDEX_SCHEMA = (
    "shard long, dim int, longest double, sizes array<int>, single boolean, vectors binary, neighbours array<binary>,"
    " members binary, member_counts binary"
)


def _augmented(v: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))
    # One scale for all keeps float32 from overflowing and leaves the order of inner products.
    return (np.hstack([v, rest[:, None]]) / max(np.sqrt(longest), 1e-300)).astype(np.float32)


def _indexer(single: bool):
    """single: the vectors are of single precision, and are kept so."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw", kind="stable")
        v = np.array(group["vec"].tolist(), np.float64)
        longest = float((v * v).sum(axis=1).max())
        graphs = build(_augmented(v, longest))
        ids = group["ids"].tolist()
        row = {
            "shard": int(group["shard"].iloc[0]),
            "dim": v.shape[1],
            "longest": longest,
            "sizes": [len(g) for g in graphs],
            "single": single,
            "vectors": v.astype(np.float32 if single else np.float64).tobytes(),
            "neighbours": [g.tobytes() for g in graphs],
            "members": np.concatenate([np.asarray(i, np.int64) for i in ids]).tobytes(),
            "member_counts": np.array([len(i) for i in ids], np.int64).tobytes(),
        }
        return pd.DataFrame([row])

    return run


class _Shard:
    def __init__(self, row: dict):
        self.v = np.frombuffer(row["vectors"], np.float32 if row["single"] else np.float64).reshape(-1, row["dim"])
        self.scale = max(np.sqrt(row["longest"]), 1e-300)
        self.x = np.concatenate([_augmented(self.v[i : i + 4096].astype(np.float64), row["longest"]) for i in range(0, len(self.v), 4096)])
        self.graphs = [np.frombuffer(b, np.int32).reshape(n, -1) for b, n in zip(row["neighbours"], row["sizes"])]
        self.members = np.frombuffer(row["members"], np.int64)
        self.ends = np.cumsum(np.frombuffer(row["member_counts"], np.int64))

    def answer(self, ids: list[int], queries: np.ndarray, k: int, ef: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, vec_id, score) of the k nearest members, the query's own aside."""
        q = (np.hstack([queries, np.zeros((len(queries), 1))]) / self.scale).astype(np.float32)
        found = search(self.x, self.graphs, q, max(ef or beam_width(len(self.x)), 2 * k))
        for query, vector, nodes in zip(ids, queries, found):
            nodes = nodes[nodes >= 0]
            score = self.v[nodes].astype(np.float64) @ vector
            best = np.argsort(-score, kind="stable")[: k + 1] if len(nodes) > k + 1 else np.arange(len(nodes))
            if len(nodes) > k + 1:
                best = np.flatnonzero(score >= score[best[-1]])
            parts = [self.members[(self.ends[n - 1] if n else 0) : self.ends[n]] for n in nodes[best]]
            if not parts:
                continue
            vec = np.concatenate(parts)
            s = np.repeat(score[best], [len(p) for p in parts])
            vec, s = vec[vec != query], s[vec != query]
            order = np.lexsort((vec, -s))[:k]
            yield np.full(len(order), query), vec[order], s[order]


def _searcher(k: int, ef: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, ([], [])

        def flush():
            if held[0]:
                found = list(shard.answer(held[0], np.array(held[1], np.float64), k, ef))
                held[0].clear()
                held[1].clear()
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["query_id"] is None:
                    yield from flush()
                    shard = _Shard(row)
                else:
                    held[0].append(row["query_id"])
                    held[1].append(row["query"])
                    if len(held[0]) >= BATCH:
                        yield from flush()
        yield from flush()

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (of single precision if the column is, else doubles) of rows that take part: no null or zero vector, all components finite."""
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vec = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda c: c != 0))


def shard_nodes(n: int, width: int, shard: int = SHARD) -> int:
    """Nodes that a shard aims at among n nodes of at most `width` components."""
    grown = max(shard, int(shard * math.sqrt(n / GROW_FROM)))
    return max(1, min(grown, SHARD_BYTES // (8 * max(1, width))))


def banded(nodes: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """nodes (vec and others) with their shard: in each dimension, by quantiles of length, and where these are of more than `target` nodes by a
    hash. And the number of shards (n) of each dimension (dim)."""
    length = F.aggregate("vec", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    nodes = nodes.withColumns({"dim": F.size("vec").cast("long"), "length": length})
    n = nodes.count()
    bands = min(BANDS, max(-(-n // target), min(FEW_BANDS, -(-n // DIRECT))))
    ends = sorted({e for e in nodes.agg(F.percentile_approx("length", [i / bands for i in range(1, bands)], 10_000)).first()[0] or []}) if bands > 1 else []
    band = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e < F.col("length"))) if ends else F.lit(0)
    nodes = nodes.withColumn("band", band)
    parts = nodes.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / target).alias("parts"))
    upto = Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("before", F.coalesce(F.sum("parts").over(upto), F.lit(0))), "bands")
    dealt = nodes.join(small(parts, BROADCAST_ROWS), ["dim", "band"])
    number = F.col("dim") * SPAN + F.col("before") + F.pmod(F.col("draw"), F.col("parts"))
    return dealt.withColumn("shard", number).drop("dim", "band", "length", "parts", "before"), parts.groupBy("dim").agg(F.sum("parts").alias("n"))


def index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The shards' flat arrays, one row each (INDEX_SCHEMA), written to the shared folder; and the number of shards (n) of each dimension (dim)."""
    rows = usable(vectors)
    single = isinstance(rows.schema["vec"].dataType.elementType, T.FloatType)
    # Equal vectors meet by 128 bits of hashes. Adding zero makes the two zeros one.
    plus = F.transform("vec", lambda c: c + F.lit(0).cast("float" if single else "double"))
    rows = rows.withColumns({"a": F.xxhash64(plus), "b": F.xxhash64(F.lit(1), plus)})
    # Of equal vectors only the k + 1 smallest identifiers can be among any query's k nearest.
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    ids = rows.select("a", "b", "vec_id").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    ids = ids.groupBy("a", "b").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    nodes = stage(rows.groupBy("a", "b").agg(F.first("vec").alias("vec")).join(ids, ["a", "b"]).select("vec", "ids"), "nodes")
    nodes = nodes.withColumn("draw", F.xxhash64(F.col("ids")[0]))
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    dealt, per_dim = banded(nodes, shard_nodes(n, width or 1, shard))
    dealt = dealt.select("shard", F.xxhash64("draw").alias("draw"), "vec", "ids")
    built = dealt.groupBy("shard").applyInPandas(_indexer(single), INDEX_SCHEMA)
    return stage(built, "shards"), per_dim


def nearest(vectors: DataFrame, every: int = 20, k: int = K, shard: int = SHARD, ef: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Null vectors, zero vectors, vectors with null or non-finite components and rows without vec_id take no part.
    Vectors of another length than the query's are no candidates. Rows repeated whole count once; an
    identifier with several vectors asks with each and is found by its best. Equal scores go by vec_id.
    An empty table gives no rows. Other columns are ignored.
    """
    shards, per_dim = index(vectors, k, shard)
    queries = stage(usable(vectors).where(F.col("vec_id") % every == 0).distinct(), "queries")
    groups = max(1, -(-queries.count() // QUERIES))
    asked = queries.withColumn("dim", F.size("vec").cast("long")).join(small(per_dim, BROADCAST_ROWS), "dim").select(
        F.col("vec_id").alias("query_id"),
        F.col("vec").alias("query"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"),
        F.explode(F.sequence(F.col("dim") * SPAN, F.col("dim") * SPAN + F.col("n") - 1)).alias("shard"),
    )
    copies = shards.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # A hash may leave some shard numbers unused.
    asked = asked.join(small(shards.select("shard"), BROADCAST_ROWS), "shard", "left_semi")
    streams = copies.unionByName(asked, allowMissingColumns=True)
    dealt = streams.repartition(F.col("shard"), F.col("g")).sortWithinPartitions("shard", "g", F.col("query_id").asc_nulls_first())
    found = map_arrow(dealt, _searcher(k, ef), "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
