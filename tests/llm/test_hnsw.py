import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = {}
    for q, u in good:
        if q % every == 0:
            near = sorted(((-float(u @ v), i) for i, v in good if i != q and len(u) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def _same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]]
        assert [s for _, s in a[q]] == pytest.approx([s for _, s in b[q]], rel=1e-12)


def test_small_shards_are_exact_with_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    same = rng.normal(size=6).astype(np.float32).tolist()
    rows += [(i, same) for i in range(200, 290)]
    rows += [(300, None), (320, [0.0] * 6), (340, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (360, [float("nan")] * 6), (380, [float("inf")] + [0.0] * 5), (None, same)]
    rows += [(400, [1.0, 2.0]), (401, [3.0, 4.0]), (500, []), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    want = brute(rows[:-1])
    _same(want, got(hnsw.nearest(df)))
    _same(want, got(hnsw.nearest(df, shard=50)))
    assert hnsw.nearest(df.limit(0)).count() == 0
    assert hnsw.nearest(df.where("vec_id = 20")).count() == 0


@pytest.mark.parametrize("lengths", [1.0, 3.0])
def test_recall_of_graphs(spark, lengths):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 32)) + 2 * rng.normal(size=(12, 32))[rng.integers(0, 12, 4000)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = (v * rng.uniform(1.0, lengths, (4000, 1))).astype(np.float32)
    rows = list(enumerate(v.tolist()))
    found = got(hnsw.nearest(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA), shard=1500))
    want = brute(rows)
    assert found.keys() == want.keys() and all(len(x) == 20 for x in found.values())
    recall = np.mean([len({i for i, _ in want[q]} & {i for i, _ in found[q]}) / 20 for q in want])
    assert recall >= 0.95


def test_levels_are_prefixes():
    x = hnsw._augmented(np.random.default_rng(1).normal(size=(3000, 8)), 60.0)
    graphs = hnsw.build(x)
    assert [len(g) for g in graphs] == hnsw._levels(3000) and len(graphs) > 1
    assert all(g.max() < len(g) and (g != np.arange(len(g))[:, None]).all() for g in graphs)


def test_shards_grow_with_the_table_up_to_a_bound():
    sizes = [hnsw.shard_nodes(n, 64) for n in (100, 1 << 16, 10**7, 10**8, 10**9, 10**12)]
    assert sizes[:2] == [hnsw.SHARD] * 2 and sizes == sorted(sizes) and hnsw.shard_nodes(1 << 22, 64) == 8 * hnsw.SHARD
    assert sizes[-1] * 64 * 8 == hnsw.SHARD_BYTES and hnsw.shard_nodes(10**9, 10**9) == 1
    assert hnsw.beam_width(hnsw.SHARD) == hnsw.EF_SEARCH and hnsw.beam_width(4 * hnsw.SHARD) == 2 * hnsw.EF_SEARCH


def _directions(n, kind, seed=8):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 64))
    if kind != "gauss":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    return (v * rng.uniform(1, 3, (n, 1)) if kind == "lengths" else v).astype(np.float32)


def _recall(v, found):
    """found: query to list of ids. Over random directions, which no graph finds easy."""
    w = v.astype(np.float64)
    queries = sorted(found)
    hits = 0
    for at in range(0, len(queries), 512):
        part = queries[at : at + 512]
        s = w[part] @ w.T
        s[np.arange(len(part)), part] = -np.inf
        near = np.argpartition(-s, 19, axis=1)[:, :20]
        hits += sum(len(set(a.tolist()) & set(found[q])) for a, q in zip(near, part))
    return hits / (20 * len(queries))


@pytest.mark.parametrize(("n", "kind"), [(3_000, "lengths"), (16_384, "gauss"), (16_384, "lengths"), (49_152, "gauss")])
def test_recall_over_unequal_lengths_at_full_size(spark, tmp_path, n, kind):
    v = _directions(n, kind)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(v), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    rows = hnsw.nearest(spark.read.parquet(str(tmp_path / "v.parquet"))).toPandas()
    found = rows.groupby("query_id")["vec_id"].apply(list).to_dict()
    assert sorted(found) == list(range(0, n, 20)) and (rows.groupby("query_id").size() == 20).all()
    assert _recall(v, found) >= 0.95


def test_recall_of_one_large_graph():
    """A shard as large as tables of a million vectors have, its nodes inserted by searching."""
    v = _directions(16_384, "unit")
    x = hnsw._augmented(v.astype(np.float64), 1.0)
    graphs = hnsw.build(x)
    queries = np.arange(0, len(v), 40)
    near = hnsw.search(x, graphs, np.hstack([v[queries], np.zeros((len(queries), 1), np.float32)]))
    assert _recall(v, {q: row[row != q][:20].tolist() for q, row in zip(queries.tolist(), near)}) >= 0.95


def test_bands_part_lengths_and_large_ones_by_hash(spark):
    rows = [([1.0, 0.0], i, i) for i in range(500)] + [([float(i), 1.0], i, i) for i in range(500, 1000)] + [([1.0], 1, 1)]
    df = spark.createDataFrame(rows, "vec array<float>, draw long, keep int")
    dealt, per_dim = hnsw.banded(df, 100)
    got = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min(F.col("vec")[0]).alias("a"), F.max(F.col("vec")[0]).alias("b")).orderBy("a").collect()
    assert sum(r.n for r in got) == 1001 and max(r.n for r in got) <= 150
    long = [r for r in got if r.a >= 500]
    assert len(long) >= 4 and all(x.b < y.a for x, y in zip(long, long[1:]))
    assert {r.dim for r in per_dim.collect()} == {1, 2} and len(got) <= sum(r.n for r in per_dim.collect())


def test_doubles_and_signed_zeros(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(100, [0.0, 1.0, 0.0, 0.0, 2.0]), (101, [-0.0, 1.0, 0.0, -0.0, 2.0])]
    want = {}
    for q, u in rows:
        if q % 20 == 0:
            near = sorted((-float(np.dot(u, v)), i) for i, v in rows if i != q)[:20]
            want[q] = [(i, -s) for s, i in near]
    _same(want, got(hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=30)))


def test_a_third_of_all_vectors_equal(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(900)]
    _same(brute([r[:2] for r in rows]), got(hnsw.nearest(spark.createDataFrame(rows, SCHEMA))))
