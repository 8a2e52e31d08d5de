import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing


def test_targets_reshare_the_excess():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 0}
    goals = mixing.targets(sizes, {"a": 5, "b": 2, "c": 1, None: 5})
    assert goals["a"] == 30 and goals[None] == 0
    assert goals["b"] == pytest.approx(1980 * 2 / 3) and goals["c"] == pytest.approx(1980 / 3)
    assert mixing.targets({}, {}) == {}


def test_flow_prefers_fresh_copies_and_meets_quotas():
    patterns = {("a",): 100, ("b",): 50, ("a", "b"): 60}
    taken = mixing.route(patterns, {"a": 130, "b": 70})
    # 200 words are asked and 210 are there, so none has to be repeated.
    assert sum(taken.values()) == 200 and all(taken[p] <= n for p, n in patterns.items())
    taken = mixing.route(patterns, {"a": 400, "b": 50})
    assert sum(taken.values()) == 450 and taken[("a",)] + taken[("a", "b")] >= 400 and all(taken[p] <= 3 * n for p, n in patterns.items())
    assert sum(mixing.route({("a",): 10}, {"a": 99}).values()) == 30


def cheapest(patterns, quotas, repeats):
    """(words, cost) of a cheapest maximal flow, word by word along cheapest paths (Bellman-Ford), on arcs of one word each."""
    nodes = ["s", "t", *(("p", k) for k in patterns), *(("q", x) for x in quotas)]
    arcs = []
    for key, n in patterns.items():
        arcs += [["s", ("p", key), n, c] for c in range(repeats)]
        arcs += [[("p", key), ("q", x), 10**9, 0] for x in key]
    arcs += [[("q", x), "t", round(q), 0] for x, q in quotas.items()]
    arcs = [x for a, b, n, c in arcs for x in ([a, b, n, c], [b, a, 0, -c])]
    words = cost = 0
    while True:
        far = {x: (0 if x == "s" else float("inf")) for x in nodes}
        via = {}
        for _ in nodes:
            for i, (a, b, n, c) in enumerate(arcs):
                if n and far[a] + c < far[b]:
                    far[b], via[b] = far[a] + c, i
        if far["t"] == float("inf"):
            return words, cost
        x = "t"
        while x != "s":
            arcs[via[x]][2] -= 1
            arcs[via[x] ^ 1][2] += 1
            x = arcs[via[x]][0]
        words, cost = words + 1, cost + far["t"]


def test_flow_equals_an_independent_solver():
    rng = random.Random(7)
    for _ in range(60):
        sources = list("abcd")[: rng.randint(1, 4)]
        patterns = {}
        for _ in range(rng.randint(1, 5)):
            patterns[tuple(sorted(rng.sample(sources, rng.randint(1, len(sources)))))] = rng.choice([0, 1, 3, 7, 12])
        quotas = {x: rng.choice([0, 1, 5, 9, 20]) for x in sources}
        repeats = rng.randint(1, 3)
        taken = mixing.route(patterns, quotas, repeats)
        dear = sum(k * max(0, min(n, taken[p] - k * n)) for p, n in patterns.items() for k in range(repeats))
        assert all(0 <= taken[p] <= repeats * n for p, n in patterns.items())
        assert (sum(taken.values()), dear) == cheapest(patterns, quotas, repeats)


@pytest.mark.parametrize("overlap", [False, True])
def test_flow_of_many_sources_takes_seconds(overlap):
    rng = random.Random(1)
    n = 20_000
    patterns = {(f"s{i}",): rng.randint(1, 10_000) for i in range(n)}
    if overlap:
        patterns |= {tuple(sorted({f"s{rng.randrange(n)}", f"s{rng.randrange(n)}"})): rng.randint(1, 10_000) for _ in range(n // 2)}
    sizes = dict.fromkeys((f"s{i}" for i in range(n)), 0)
    for key, size in patterns.items():
        for s in key:
            sizes[s] += size
    started = time.monotonic()
    goals = mixing.targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(mixing.source_order(list(sizes)))})
    taken = mixing.route(patterns, goals)
    assert time.monotonic() - started < 30
    if not overlap:
        assert all(taken[(s,)] == min(round(g), 3 * sizes[s]) for s, g in goals.items())


def waterfilled(sizes, weights, repeats=3):
    """Targets by bisection of the level to which shares rise, each source's at most `repeats` times its size."""
    whole = sum(sizes.values())
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(weights[s] * mid, repeats * n) for s, n in sizes.items()) < whole else (low, mid)
    return {s: min(weights[s] * low, repeats * n) for s, n in sizes.items()}


def _docs(spark, n=900, seed=1):
    rng = random.Random(seed)
    sources = ["src1", "src10", "Ünion", None, "z"]
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))) + "\t\n" for _ in range(n)]
    rows = [(i, t if i % 50 else None, "en", sources[min(4, int(rng.random() ** 2 * 5))], len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_meets_its_targets_and_agrees_with_itself(spark):
    docs = _docs(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    by = {}
    for r in rows:
        text, source = texts[r.doc_id]
        assert r.size == len((text or "").split()) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by.setdefault(source, []).append(r)
    sizes = {s: sum(r.size for r in x) for s, x in by.items()}
    # By code point, null last: the two of Latin letters, z, then the one beyond ASCII.
    want = waterfilled(sizes, {"src1": 5, "src10": 2, "z": 1, "Ünion": 5, None: 2})
    for s, x in by.items():
        assert {r.source_size for r in x} == {sizes[s]} and x[0].target == pytest.approx(want[s])
        assert x[0].target == pytest.approx(mixing.targets(sizes, {"src1": 5, "src10": 2, "z": 1, "Ünion": 5, None: 2})[s])
        assert abs(sum(r.taken for r in x) - want[s]) <= max(r.size for r in x) / 2 + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other = mixing.mix(docs, seed=5).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows))


def test_overlapping_sources(spark):
    docs = _docs(spark).withColumn("more", F.when(F.col("doc_id") % 3 == 0, F.array("source", F.lit("z"))).otherwise(F.array("source")))
    rows, _ = mixing.measured(docs, F.col("more"))
    plan = mixing.plan_mix(rows)
    goal = plan.sources.agg(F.sum("target")).first()[0]
    assert goal == pytest.approx(rows.agg(F.sum("size")).first()[0])
    taken = plan.copies(rows).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert taken == pytest.approx(goal, rel=0.05)
    with pytest.raises(ValueError, match="overlapping"):
        mixing.plan_mix(rows, most=2)


def test_more_patterns_than_the_driver_holds(spark):
    """Beyond the bound the flow of sources that do not overlap is found in Spark, with the same result."""
    docs = _docs(spark).withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.concat(F.lit("host"), F.col("doc_id") % 83)))
    rows, _ = mixing.measured(docs, F.array("source"))
    near, far = (mixing.plan_mix(rows, most=m) for m in (mixing.MAX_PATTERNS, 0))
    assert sorted(map(tuple, near.plan.collect())) == sorted(map(tuple, far.plan.collect()))
    a, b = ({r.source: (r.size, r.target) for r in m.sources.collect()} for m in (near, far))
    assert a.keys() == b.keys() and all(a[s][0] == b[s][0] and a[s][1] == pytest.approx(b[s][1]) for s in a)
    given = {s: 1 + i % 4 for i, s in enumerate(mixing.source_order(list(a)))}
    near, far = (mixing.plan_mix(rows, given, most=m) for m in (mixing.MAX_PATTERNS, 0))
    assert sorted(map(tuple, near.plan.collect())) == sorted(map(tuple, far.plan.collect()))


def test_targets_are_met_without_identifiers(spark):
    """Rows without doc_id, rows that share one, and rows equal in all: each source comes near its target all the same."""
    for rows in (
        [(None, f"one two three four {i}", "ab"[i % 2]) for i in range(100)],
        [(7, f"one two three four {i}", "ab"[i % 2]) for i in range(100)],
        [(None, "one two three four five", "ab"[i % 2]) for i in range(100)],
        [(i // 2 % 5, "one two three four five", "ab"[i % 2]) for i in range(100)],
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        out = mixing.mix(docs).withColumn("source", F.when(F.col("target") > 300, "a").otherwise("b")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
        got = {r.source: r for r in out.collect()}
        assert got["a"].target == pytest.approx(500 * 5 / 7) and got["b"].target == pytest.approx(500 * 2 / 7)
        assert all(abs(r.taken - r.target) <= 3 for r in got.values())
        kept = mixing.mix_documents(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
        assert {r.source: r.taken for r in kept} == {s: r.taken for s, r in got.items()}


def test_odd_tables(spark):
    docs = _docs(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    same = docs.where("doc_id = 7").union(docs.where("doc_id = 7")).withColumn("size", F.lit("x")).withColumn("doc_id", F.lit(None).cast("long"))
    got = mixing.mix(same).collect()
    assert len(got) == 2 and sum(r.taken for r in got) == sum(r.size for r in got)
    empty = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r.taken for r in mixing.mix(empty).collect()} == {0}


def test_documents_carry_the_decision(spark):
    docs = _docs(spark)
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    out = mixing.mix_documents(docs.withColumn("copies", F.lit("own")))
    assert out.columns[:5] == docs.columns
    assert {r.doc_id: r.taken for r in out.collect()} == want


def test_clashing_columns(spark):
    docs = _docs(spark, 200)
    clash = ["k", "key", "h", "who", "whole", "cut", "number", "part", "line", "again", "s", "w", "p", "o", "_k", "_h", "_s", "_copies", "source_name", "Members"]
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clash})
    more = more.union(more.where("doc_id < 20"))
    out = mixing.mix_documents(more)
    assert out.columns == [*more.columns, "size", "source_size", "target", "copies", "taken"]
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in clash)
