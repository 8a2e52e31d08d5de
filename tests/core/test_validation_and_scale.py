import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph, operations, ranking, retrieval, validation
from siltstone.operators.components import components
from siltstone.sources import jsonl, staging

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_papers_are_normalised_and_judged(spark):
    schema = "id string, title string, authors array<string>, doi_aliases array<string>, publication_year int, citation_count int, final_score double, ranking_mode string, full_text_locations array<struct<url:string,source_format:string>>"
    rows = [
        ("p1", " A  title ", ["Ann  Lee", "ANN LEE", "", None, "Jo"], ["https://doi.org/10.1/X/", "HTTPS://doi.org/10.1/x"], 2020, 3, 0.5, "hybrid", [("https://x/a/", "pdf"), ("HTTPS://x/a", "html"), ("u", "xml")]),
        ("", "  ", None, None, 999, -1, 1.5, "other", None),
        (None, "t", ["b", "B"], [], None, 0, None, None, []),
    ]
    df = spark.createDataFrame(rows, schema)
    a, b, _ = validation.normalised_papers(df).collect()
    assert (a.title, a.authors, a.doi_aliases) == ("A title", ["Ann Lee", "Jo"], ["https://doi.org/10.1/X"]) and [x.url for x in a.full_text_locations] == ["https://x/a/", "u"]
    assert b.id is None and b.title is None and b.authors is None
    got = {(r.id, r.field, r.reason) for r in validation.violations(df).collect()}
    assert got == {
        ("p1", "authors", "repeated value"), ("p1", "doi_aliases", "repeated value"), ("", "id", "empty"), ("", "title", "empty"), ("", "publication_year", "out of bounds"), ("", "citation_count", "negative"),
        ("", "final_score", "out of bounds"), ("", "ranking_mode", "unknown name"), (None, "id", "empty"), (None, "authors", "repeated value"),
    }
    t = spark.createDataFrame([(1, "a", 5), (1, "b", 50), (None, "z", 7)], "k int, s string, n int")
    bad = validation.table_violations(t, required=("k",), unique=("k",), bounds={"n": (0, 10)}, choices={"s": ("a", "b")})
    assert {(r.field, r.reason, r.value, r.n) for r in bad.collect()} == {("k", "missing", None, 1), ("k", "repeated key", "1", 2), ("n", "out of bounds", "50", 1), ("s", "unknown name", "z", 1)}


def test_bounded_graph_in_order_of_names(spark):
    papers = spark.createDataFrame([(i, p, [a]) for i, (p, a) in enumerate([("b", "W1"), ("A", "W2"), ("c", "W3"), ("D", "W4")])], "ord int, paper_id string, aliases array<string>")
    refs = spark.createDataFrame([("b", "W2"), ("A", "W1"), ("c", "W9"), ("c", "W1"), ("D", "W1"), ("b", "W1")], "paper_id string, reference string")
    nodes, edges = graph.bounded(papers, refs, spark.createDataFrame([("c",)], "paper_id string"), 3)
    assert [(r.paper_id, r.in_degree, r.out_degree, r.external_reference_count, r.selected) for r in nodes.orderBy("ord").collect()] == [("A", 1, 1, 0, False), ("b", 2, 1, 0, False), ("c", 0, 1, 1, True)]
    assert [(r.citing_paper_id, r.cited_paper_id) for r in edges.orderBy("ord").collect()] == [("A", "b"), ("b", "A"), ("c", "b")]
    with pytest.raises(ValueError):
        graph.bounded(papers, refs, max_nodes=501)


def test_routes_score_by_mode(spark):
    papers = spark.createDataFrame([(1, "river floods", "graph networks"), (2, "river", "trees"), (3, "floods", "x")], "id int, title string, abstract string")
    q = spark.createDataFrame([(7, 0, "river floods"), (7, 1, "trees")], "idea_id int, ord int, text string")
    routes = retrieval.routes(q)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vector array<double>")
    asked = spark.createDataFrame([(7, 2, [0.0, 2.0])], "idea_id int, route_ord int, vector array<double>")
    got = {}
    for r in retrieval.route_scores(papers, routes, vectors, asked).collect():
        got.setdefault(r.route_ord, {})[r.id] = r.score
    assert {k: set(x) for k, x in got.items()} == {0: {1, 2, 3}, 1: {1}, 2: {1, 2}, 3: {2}} and got[2] == {1: 0.0, 2: 1.0}
    with pytest.raises(ValueError):
        retrieval.route_scores(papers, routes.withColumn("mode", F.lit("odd")))


def test_inserts_under_two_keys(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = [(i, rng.choice([None, *"abcd"]), rng.choice([None, *range(5)])) for i in rng.sample(range(100), 25)]
        seen, want = set(), []
        for i, a, b in sorted(rows):
            keys = {k for k in (("a", a), ("b", b)) if k[1] is not None}
            if not keys & seen:
                seen |= keys
                want.append(i)
        df = spark.createDataFrame(rows, "arrival int, a string, b int")
        assert sorted(r.arrival for r in operations.idempotent(df, [["a"], ["b"]]).collect()) == want
    one = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "arrival int, a string")
    assert sorted(r.arrival for r in operations.idempotent(one, [["a"]]).collect()) == [1, 3, 4]


def test_lines_of_files_read_in_splits(spark, tmp_path):
    for n, name in ((2000, "a.jsonl"), (3, "b.jsonl")):
        (tmp_path / name).write_text("\n".join('{"id": "%s%d", "n": %d}' % (name, i, i) if i % 7 else "" for i in range(1, n + 1)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonl.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 2
        got = sorted((r.file[-7:], r.line, r.value) for r in rows.collect())
        assert got == sorted((name, i, '{"id": "%s%d", "n": %d}' % (name, i, i)) for n, name in ((2000, "a.jsonl"), (3, "b.jsonl")) for i in range(1, n + 1) if i % 7)
        good, bad = jsonl.load(spark, str(tmp_path), "id string, n int", "id")
        assert good.count() == len(got) and bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_query_vectors_in_blocks(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(40, 4)), rng.normal(size=(1500, 4))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, vector array<double>")
    got = ranking.semantic(vectors, queries, block=200, many=3)
    want = (v @ q.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(q, axis=1)
    rows = got.collect()
    assert len(rows) == 60_000 and all(abs(r.semantic_raw_score - want[r.id, r.query_id]) < 1e-12 for r in rows)


def test_ranking_plans_have_no_products(spark):
    papers = spark.createDataFrame([(i, f"title {i}", "graph networks") for i in range(30)], "id int, title string, abstract string")
    queries = spark.createDataFrame([(1, "graph"), (2, "graph networks"), (3, "graph networks title")], "query_id int, text string")
    vectors = papers.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    lexical = ranking.bm25(papers, queries)
    scored = ranking.semantic(vectors, vectors.where("id < 3").withColumnRenamed("id", "query_id"))
    ranked = ranking.fuse(scored.join(lexical, ["query_id", "id"], "left").withColumn("lexical_raw_score", F.coalesce("lexical_raw_score", F.lit(0.0))))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan
    toks = ranking.tokenised(papers)
    plan = ranking.phrase_hits(toks, queries, lexical.withColumns({"n_hit": F.lit(3), "n": F.lit(3)}))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_short_phrases_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé1") for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 4))), " ".join(word() for _ in range(rng.randint(0, 5)))) for i in range(60)]
    asked = [(i, " ".join(word() for _ in range(1 + i % 2))) for i in range(40)]
    papers = spark.createDataFrame(rows, "id int, title string, abstract string")
    queries = spark.createDataFrame(asked, "query_id int, text string")
    toks = ranking.tokenised(papers)
    none = spark.createDataFrame([], "query_id int, id int, n_hit int, n int")
    got = {(r.query_id, r.id): r.bonus for r in ranking.phrase_hits(toks, queries, none).collect()}
    body = {r.id: (" ".join(r.tt), " ".join(r.ta)) for r in toks.collect()}
    phrase = {r.query_id: r.p for r in queries.select("query_id", ranking.t.phrase(F.col("text")).alias("p")).collect()}
    want = {(q, i): 2.0 if p in a else 0.75 for q, p in phrase.items() for i, (a, b) in body.items() if p and (p in a or p in b)}
    assert got == want and len(want) > 50


def test_a_star_of_many_edges(spark):
    n = 100_000
    edges = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    found = components(edges)
    assert found.count() == n + 1 and found.where("root != 0").isEmpty()


def test_a_cluster_has_to_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf = {"spark.sql.warehouse.dir": "/tmp/x"}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_entry_works_where_something_cannot_be_imported():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'op1_license_scan' in q, set(e.oracle_sql()) <= set(q))"
    env = dict(os.environ, PYTHONPATH=os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]))
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 70 and out[1:] == ["False", "True"]
