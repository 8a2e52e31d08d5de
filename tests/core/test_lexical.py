import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical, ranking
from siltstone.plans import ablation

WORDS = ["river", "riverbed", "flood", "floods", "graph", "graphs", "net", "network", "C++", "Straße", "the", "of", "deep", "cat"]


def _corpus(spark, n=60):
    rnd = random.Random(3)
    say = lambda most: " ".join(rnd.choices(WORDS, k=rnd.randrange(most)))
    rows = [(i, say(6), say(25) if i % 9 else None) for i in range(n)] + [(n, None, None), (n + 1, "the of", ""), (n + 2, "river floods", "graph networks"), (n + 3, "river floods", "graph networks")]
    asked = ["river floods", "at", "graph", "the", "", "r f", "deep river flood", "iver flood gra", "networks graph net network", "cat cat cat", "C++ strasse", "zebra"]
    return spark.createDataFrame(rows, "id int, title string, abstract string"), spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(asked)], "query_id string, text string")


def _rows(df):
    return {(r.query_id, r.id): r.lexical_raw_score for r in df.collect()}


def _same(got, want):
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("cells, most", [(1 << 20, 100_000), (7, 100_000), (1 << 20, 3)])
def test_scores_on_demand_equal_bm25(spark, monkeypatch, cells, most):
    monkeypatch.setattr(lexical, "CELLS", cells)
    papers, queries = _corpus(spark)
    want = _rows(ranking.bm25(papers, queries))
    made = lexical.scores(papers, queries, most=most)
    assert isinstance(made, lexical.Coded if most > 3 else lexical.Listed)
    _same(_rows(made.reaching(queries.select("query_id", F.lit(None).cast("double").alias("floor")))), want)
    _same(_rows(made.reaching(queries.where("query_id = 'q0'").select("query_id", F.lit(2.0).alias("floor")))), {k: s for k, s in want.items() if k[0] == "q0" and s >= 2.0})
    pairs = spark.createDataFrame([(q, i) for q in ("q0", "q5", "q11") for i in range(0, 64, 3)], "query_id string, id int")
    _same(_rows(made.of(pairs)), {k: s for k, s in want.items() if k[0] in ("q0", "q5", "q11") and k[1] % 3 == 0})
    top, spread = made.best(4, 6)
    first = {}
    for (q, i), s in sorted(want.items(), key=lambda x: (x[0][0], -round(x[1], 6), x[0][1])):
        first.setdefault(q, []).append(((q, i), s))
    _same(_rows(top), dict(x for rows in first.values() for x in rows[:4]))
    by = {r.query_id: r for r in spread.collect()}
    for q, rows in first.items():
        assert by[q]._n == len(rows) and math.isclose(by[q]._lo, min(s for _, s in rows)) and math.isclose(by[q]._hi, max(s for _, s in rows))
    _same(_rows(made.within(papers.where("id % 2 = 0").select("id")).best(1000)[0]), {k: s for k, s in want.items() if k[1] % 2 == 0})


def test_first_of_a_task_are_picked_while_it_runs(spark, monkeypatch):
    papers, queries = _corpus(spark)
    monkeypatch.setattr(lexical, "CELLS", 30)
    monkeypatch.setattr(lexical, "HELD", 5)
    want = {}
    for (q, i), s in sorted(_rows(ranking.bm25(papers, queries)).items(), key=lambda x: (x[0][0], -round(x[1], 6), x[0][1])):
        want.setdefault(q, []).append(i)
    found = lexical.scores(papers.coalesce(1), queries)
    rows = found.coded.coalesce(1).mapInArrow(lexical._first(found.model, 3, 6), lexical.SCORED).where("id is not null").join(found.names, "q")
    # One task sends three rows a query at most, whatever number of papers it reads.
    assert {r.query_id: r["count"] for r in rows.groupBy("query_id").count().collect()} == {q: min(3, len(ids)) for q, ids in want.items()}
    got = {}
    for r in found.best(3, 6)[0].collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {q: set(ids[:3]) for q, ids in want.items()}


def test_ablation_with_vectors_equals_all_pairs(spark):
    rnd = random.Random(5)
    papers, _ = _corpus(spark)
    papers = papers.select(F.col("id").cast("long").alias("id"), "title", "abstract")
    ideas = spark.createDataFrame([(1, "Using graph networks to detect river floods"), (2, "deep networks for floods of the river")], "idea_id long, text string")
    e = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(50)], "id long, vector array<double>")
    q = e.where("id in (1, 2)").select(F.col("id").alias("query_id"), "vector")
    key = lambda df: sorted((r.variant, r.idea_id or 0, r.ord or 0, r.id or 0, r.reason or "") for r in df.collect())
    all_pairs = ranking.semantic(e, q).withColumnRenamed("query_id", "idea_id")
    assert key(ablation.variants(papers, ideas, vectors=(e, q))) == key(ablation.variants(papers, ideas, semantic=all_pairs))
