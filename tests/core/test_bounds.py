import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import bounds, ranking

V, Q = "id long, vector array<double>", "query_id long, vector array<double>"


def cosines(v, q):
    a, b = np.array(q, float), np.array(v, float)
    length = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    return np.round(np.divide(a @ b.T, length, out=np.zeros_like(length), where=length > 0), bounds.DIGITS) + 0.0


def brute(v, q, k):
    """{query: [(id, score)]} in order."""
    ids = np.array([i for i, _ in v])
    return {a: [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]] for (a, _), s in zip(q, cosines([x for _, x in v], [x for _, x in q]))}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(n, seed=0, centres=20, dim=8):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return (c[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, dim))).tolist()


@pytest.mark.parametrize("kind", ["clustered", "random", "third equal"])
def test_equal_to_scoring_everything(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    rows = clustered(1200) if kind == "clustered" else rng.normal(size=(900, 8)).tolist()
    if kind == "third equal":
        rows = [rows[0] if i % 3 == 0 else x for i, x in enumerate(rows)]
    v = [(7 * i - 40, x) for i, x in enumerate(rows)] + [(100_000, [0.0] * 8), (100_001, [2.0 * x for x in rows[5]])]
    q = [(i, rows[i]) for i in range(0, 60, 3)] + [(900, [0.0] * 8), (901, [-x for x in rows[1]])]
    vectors, queries = spark.createDataFrame(v, V), spark.createDataFrame(q, Q)
    made = bounds.gather(vectors, block=64)
    assert made.blocks.count() > len(made.pivots) - 1 and int(made.count.sum()) == len(v)
    for k in (1, 10):
        assert got(bounds.nearest(made, queries, k)) == brute(v, q, k)
    monkeypatch.setattr(bounds, "QUERIES", 5)
    monkeypatch.setattr(bounds, "BATCH", 3)
    assert got(bounds.nearest(made, queries, 12)) == brute(v, q, 12)
    s = cosines([x for _, x in v], [x for _, x in q])
    best, worst = bounds.both_ends(made, queries, 4)
    assert got(best) == brute(v, q, 4)
    assert {r.query_id: r.score for r in worst.collect()} == {a: row.min() for (a, _), row in zip(q, s)}
    floors = spark.createDataFrame([(a, x, 0.9) for a, x in q], Q + ", floor double")
    reached = sorted((r.query_id, r.id, r.score) for r in bounds.within(made, floors).collect())
    assert reached == sorted((a, v[j][0], row[j]) for (a, _), row in zip(q, s) for j in np.flatnonzero(row >= 0.9))


def test_bounds_hold_and_rule_out(spark):
    rows = clustered(3000, 2)
    made = bounds.gather(spark.createDataFrame(list(enumerate(rows)), V))
    q = bounds._unit(clustered(50, 3) + np.random.default_rng(4).normal(size=(50, 8)).tolist())
    by = {}
    for r in made.blocks.collect():
        by.setdefault(r.p, []).append(np.array(r["values"]).reshape(len(r.ids), -1))
    limit = made.bounds(q)
    for p, parts in by.items():
        assert ((q @ np.vstack(parts).T).max(axis=1) <= limit[:, p]).all()
    queries = spark.createDataFrame(list(enumerate(clustered(40, 2))), Q)
    assert bounds.ruled_out(made, queries, 10) > 0.8
    plan = bounds._visited(made, queries.selectExpr("query_id", "cast('' AS binary) AS q", "0.0D AS floor", "0 AS p", "0 AS s"), 10, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Cartesian" not in plan


def test_odd_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 1.0])], V)
    q = spark.createDataFrame([(5, [1.0, 1.0]), (6, None)], Q)
    made = bounds.gather(v)
    assert got(bounds.nearest(made, q, 10)) == {5: [(1, 0.707107), (3, 0.707107)]}
    none = bounds.gather(v.limit(0))
    assert bounds.nearest(none, q, 3).count() == 0 and bounds.within(none, q.selectExpr("*", "0.0D AS floor")).count() == 0
    assert bounds.nearest(made, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        bounds.gather(v.unionByName(spark.createDataFrame([(9, [1.0])], V)))
    with pytest.raises(ValueError):
        bounds.nearest(made, spark.createDataFrame([(9, [1.0])], Q), 1)


def test_hybrid_topk_equals_fusing_all(spark):
    rows = clustered(300, 5)
    v, q = spark.createDataFrame(list(enumerate(rows)), V), spark.createDataFrame([(i, rows[i * 7]) for i in range(12)], Q)
    lex = spark.createDataFrame([(a, (a * 31 + j * 17) % 300, 0.3 * (j % 7) + 0.1) for a in range(10) for j in range(25)], "query_id long, id long, lexical_raw_score double")
    every = ranking.semantic(v, q).join(lex, ["query_id", "id"], "left").na.fill(0.0, ["lexical_raw_score"])
    want = ranking.top_k(ranking.fuse(every), [F.desc(F.round("final_score", 6)), F.asc("id")], 8)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.final_score, 9)) for r in df.collect())
    assert key(ranking.hybrid_topk(v, q, lex, 8)) == key(want)
