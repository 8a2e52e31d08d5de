"""SimHash near-duplicates, with exact pairs within a Hamming radius found by vantage-point trees.

1. Every text gets a 64-bit fingerprint; equal fingerprints fold into one node, so copies cost nothing
   further.
2. A vantage-point tree over a bounded sample of nodes cuts the space into shards: at a tree node with
   vantage v and radius mu, fingerprints with d(v, x) <= mu go inside, the others outside. A pair
   within r whose ends lie on both sides has its outer end within mu + r of v (triangle inequality),
   so the outer ends in that band visit the inner side as well; below, a visitor goes to each side
   that its ball of radius r touches. Each shard then holds all pairs that belong to it.
3. Each shard builds its own tree and searches it with members and visitors, pruning by the same
   bounds. It emits a spanning forest of the links it finds, never the pairs of a group.
4. The forests' edges give components by star rounds (siltstone/operators/components.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm import jaccard
from siltstone.llm._common import bounded_batches, fresh, map_arrow, small, stage
from siltstone.operators.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Rows of identifiers (8 bytes each) that may be broadcast to drop documents by.
BROADCAST_ROWS = 1_000_000
#: Fingerprints a shard aims at, and shards at most; beyond, shards grow (8 bytes a fingerprint).
SHARD = 65_536
MAX_SHARDS = 4_096
#: Sampled fingerprints for each shard of the upper tree: at most MAX_SHARDS times as many reach the driver.
SAMPLE_PER_SHARD = 64
LEAF = 64
#: Pairs held before they are folded into the forest.
FOLD_AT = 2_000_000
#: Shingles hashed at once.
CHUNK = 1 << 17

_TO_SPACE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(1).to_pylist()]
        prints = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.record_batch([batch.column(0), prints, *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", keyed: bool = False) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").alias("text"))
    if keyed:
        return map_arrow(rows.withColumn("key", jaccard.text_key(F.col("text"))), _fingerprints, "id long, fp long, key long")
    return map_arrow(rows, _fingerprints, "id long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """A vantage-point tree as flat arrays: child links below zero are leaves ~leaf."""

    def __init__(self, points: np.ndarray, leaf: int, radius: int, max_leaves: int | None = None):
        self.vantage: list[int] = []
        self.mu: list[int] = []
        self.inner: list[int] = []
        self.outer: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.radius = radius
        self.points = points
        self.root = self._build(np.arange(len(points)), leaf, max_leaves)

    def _leaf(self, idx: np.ndarray) -> int:
        self.leaves.append(idx)
        return ~(len(self.leaves) - 1)

    def _build(self, idx: np.ndarray, leaf: int, max_leaves: int | None) -> int:
        if len(idx) <= leaf or (max_leaves is not None and max_leaves < 2):
            return self._leaf(idx)
        best = None
        some = idx[:: max(1, len(idx) // 512)]
        for v in self.points[idx[:: max(1, len(idx) // 6)]][:6]:
            counts = np.bincount(_distance(self.points[some], v), minlength=66 + self.radius)
            below = np.cumsum(counts) / len(some)
            # The band that visits, against how even the halves are.
            for mu in range(64):
                if 0.25 <= below[mu] <= 0.75:
                    cost = below[mu + self.radius] - below[mu] + abs(below[mu] - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, mu)
        if best is None:
            v = self.points[idx[0]]
            d = _distance(self.points[idx], v)
            mu = int(np.median(d))
            mu = mu if (d > mu).any() else mu - 1
            best = (0, v, mu)
        _, v, mu = best
        near = _distance(self.points[idx], v) <= mu
        if near.all() or not near.any():
            return self._leaf(idx)
        at = len(self.mu)
        self.vantage.append(int(v))
        self.mu.append(int(mu))
        self.inner.append(0)
        self.outer.append(0)
        half = None if max_leaves is None else max_leaves // 2
        self.inner[at] = self._build(idx[near], leaf, half)
        self.outer[at] = self._build(idx[~near], leaf, half)
        return at

    def homes(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indices of x, whether the leaf is their home): each home once, and every leaf that a link needs."""
        todo = [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            at, idx, home = todo.pop()
            if not len(idx):
                continue
            if at < 0:
                yield ~at, idx, home
                continue
            d = _distance(x[idx], np.uint64(self.vantage[at]))
            mu, r = self.mu[at], self.radius
            inside = d <= mu
            visit = ~inside & (d <= mu + r)
            go_in = inside | visit
            todo.append((self.inner[at], idx[go_in], home[go_in] & inside[go_in]))
            go_out = ~inside | (~home & (d > mu - r))
            todo.append((self.outer[at], idx[go_out], home[go_out]))

    def reached(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices of x, indices of points) for each leaf that balls around x touch."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, idx = todo.pop()
            if not len(idx):
                continue
            if at < 0:
                yield idx, self.leaves[~at]
                continue
            d = _distance(x[idx], np.uint64(self.vantage[at]))
            mu, r = self.mu[at], self.radius
            todo.append((self.inner[at], idx[d <= mu + r]))
            todo.append((self.outer[at], idx[d > mu - r]))


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining a[i] with b[i]: each index ends at the least index of its component."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def links(members: np.ndarray, visitors: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links member-member and member-visitor: two arrays of fingerprints."""
    points = np.concatenate([members, visitors])
    tree = Tree(members, LEAF, radius)
    labels = np.arange(len(points))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0
    for start in range(0, len(points), 1 << 15):
        x = points[start : start + (1 << 15)]
        for q, m in tree.reached(x):
            rows = max(1, (1 << 21) // max(1, len(m)))
            for s in range(0, len(q), rows):
                part = q[s : s + rows]
                i, j = np.nonzero(_distance(x[part][:, None], members[m][None, :]) <= radius)
                a, b = part[i] + start, m[j]
                keep = a > b
                if keep.any():
                    held.append((a[keep], b[keep]))
                    n_held += int(keep.sum())
                if n_held > FOLD_AT:
                    labels = forest(labels, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held, n_held = [], 0
    if held:
        labels = forest(labels, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
    child = np.flatnonzero(labels != np.arange(len(points)))
    return points[child], points[labels[child]]


def _sharder(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, idx, home in tree.homes(x):
                n = len(idx)
                yield pa.record_batch(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(x[idx].view(np.int64)), pa.array(home)],
                    ["shard", "fp", "home"],
                )

    return run


def _shard_links(radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy(dtype=bool)
        u, v = links(np.unique(fp[home]), np.unique(fp[~home]), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: fp (distinct, staged). Edges u, v whose components are those of all links within radius."""
    n = nodes.count()
    shards = 1
    while shards < MAX_SHARDS and shards * SHARD < n:
        shards *= 2
    wanted = SAMPLE_PER_SHARD * shards
    share = min(1.0, 1.5 * wanted / max(1, n))
    sample = nodes.select("fp").where(F.expr(f"pmod(xxhash64(fp), 1000003) < {int(share * 1000003) + 1}"))
    points = np.array(sorted(r.fp for r in sample.limit(2 * wanted).collect()), np.int64).view(np.uint64)
    tree = Tree(np.random.default_rng(SEED).permutation(points), 1, radius, shards)
    tree.points, tree.leaves = points[:0], []  # only the upper tree travels
    dealt = map_arrow(nodes.select("fp"), _sharder(tree), "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(_shard_links(radius), "u long, v long")


def _grouped(docs: DataFrame, radius: int, share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, staged; and fp, grp (the component's root, or fp itself), component_id, least id of every fingerprint."""
    rows = stage(fingerprints(docs, keyed=share is not None), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    edges = link_fingerprints(nodes, radius)
    if share is not None:
        edges = jaccard.links(docs, rows, stage(edges, "links"), share)
    roots = components(edges).select(F.col("u").alias("fp"), "root")
    linked = stage(nodes.join(roots, "fp").select("fp", "root", "least"), "linked")
    first = linked.groupBy("root").agg(F.min("least").alias("first"))
    named = linked.join(first, "root").select(F.col("fp").alias("fp2"), "root", "first")
    # A linked component whose rows have no doc_id at all has no first; its nodes have no least either.
    found = nodes.join(named, F.col("fp") == F.col("fp2"), "left")
    return rows, found.select("fp", F.coalesce("root", "fp").alias("grp"), F.coalesce("first", "least").alias("component_id"), "least")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach).

    Null, empty and blank texts have the fingerprint zero and link like any other. Repeated rows are
    linked to each other. A null doc_id never names a component while the component has another; alone
    it gives a null component_id. An empty table gives no rows. Other columns are ignored.
    """
    rows, groups = _grouped(docs, radius)
    return rows.join(groups, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@F.pandas_udf(T.LongType())
def _fingerprint_udf(texts: pd.Series) -> pd.Series:
    found = [fingerprint(t if isinstance(t, str) else None) for t in texts]
    return pd.Series(np.array(found, np.uint64).view(np.int64))


def keep_first(docs: DataFrame, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS, share: float | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the least doc_id. All columns stay.

    With share, all texts whose five-word shingles have that Jaccard similarity or more are linked too (jaccard.py).

    A null doc_id comes after all others; among equal ones the least fingerprint decides, and of rows
    equal in both any one stays. Where every doc_id is set and unique, rows are dropped by it (a
    broadcast if a count has shown them to be few, else a join); otherwise by doc_id and fingerprint.
    Null, empty and blank texts have the fingerprint zero and are near-duplicates of each other. Other columns keep
    names and values, whatever the names. An empty table gives no rows.
    """
    rows, groups = _grouped(docs, radius, share)
    # The row that stays is found among fingerprints, where copies have folded; rows meet it by one join.
    groups = stage(groups.select("fp", "grp", "least"), "groups")
    best = groups.groupBy("grp").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("b"))
    best = best.select("grp", F.col("b.least").alias("bid"), F.col("b.fp").alias("bfp"))
    placed = stage(rows.join(groups.join(best, "grp").select("fp", "bid", "bfp"), "fp").select("id", "fp", "bid", "bfp"), "placed")
    if placed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull()).isEmpty():
        (out,) = fresh(["gone"], docs.columns)
        gone = small(stage(placed.where(F.col("id") != F.col("bid")).select(F.col("id").alias(out)), "dropped"), broadcast_rows)
        return docs.join(gone, docs["doc_id"].cast("long") == F.col(out), "left_anti")
    fp, place, bid2, bfp2 = fresh(["fp", "place", "bid", "bfp"], docs.columns)
    bounded_batches(docs.sparkSession)
    marked = docs.withColumn(fp, _fingerprint_udf("text"))
    chosen = placed.select(F.col("bid").alias(bid2), F.col("bfp").alias(bfp2)).distinct()
    same = F.col(fp).eqNullSafe(F.col(bfp2)) & docs["doc_id"].cast("long").eqNullSafe(F.col(bid2))
    one = F.row_number().over(Window.partitionBy("doc_id", fp).orderBy(fp))
    kept = marked.join(chosen, same, "left_semi").withColumn(place, one).where(F.col(place) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
