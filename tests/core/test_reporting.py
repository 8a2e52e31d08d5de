import json

from pyspark.sql import functions as F

from siltstone.operators import documents, gaps, planning, reporting
from siltstone.plans import ablation


def test_lists_and_payloads(spark):
    df = spark.createDataFrame([(1, "an idea", "an idea", [" A  b", "a B", "", None, "c"], [f"k{i}" for i in range(20)]), (2, "RAG", "rag", ["x"], [])], "idea_id int, original_text string, given_text string, problem array<string>, keywords array<string>")
    (r,) = reporting.normalise_payload(df, ["problem", "keywords"]).collect()
    assert r.problem == ["A b", "c"] and len(r.keywords) == 12
    q = [(1, 0, "deep nets", "s1"), (1, 1, "Deep  NETS", "s2"), (1, 2, "other words", "s1"), (1, 3, "one", "s3"), (1, 4, "other words", "s2")]
    got = reporting.normalise_generated(spark.createDataFrame(q, "idea_id int, ord int, text string, strategy string")).orderBy("ord").collect()
    assert [(x.text, x.strategy) for x in got] == [("deep nets", "s1"), ("other words", "s2")]


def test_public_results(spark):
    df = spark.createDataFrame([("t", 0.5, None)], "title string, confidence double, year int")
    assert json.loads(reporting.as_json(df).first()[0]) == {"title": "t", "year": None}
    assert reporting.legacy(spark.createDataFrame([("i", 2020)], "id string, publication_year int")).columns == ["id", "year"]
    cov = [("abstract", "success", True, "fetch_failed", False), ("none", "failure", True, "parse_failed", True), ("full_text", "success", True, "usable", True)]
    s = reporting.coverage_summary(spark.createDataFrame(cov, "final_evidence_level string, final_state string, full_text_attempted boolean, full_text_status string, truncated boolean")).first()
    assert (s.requested, s.accounted, s.final_failures, s.full_text_attempts, s.fetch_failures, s.truncations, s.partial) == (3, 3, 1, 3, 1, 2, True)
    runs = spark.createDataFrame([(2.0, 1, 2, 5, None, None), (4.0, 0, 0, None, None, None)], "seconds double, hits int, requests int, input_tokens int, output_tokens int, cost double")
    p = reporting.performance(runs).first()
    assert (p.mean_seconds, p.hit_rate, p.input_tokens, p.output_tokens, p.cost) == (3.0, 0.25, 5, None, None)
    assert reporting.stage_seconds(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "run_id int, stage string, seconds double")).first().seconds == 3.0


def test_conflict_candidates_and_their_queries(spark):
    c = spark.createDataFrame([(1, 2, "floods"), (2, 3, "floods"), (1, 4, "other")], "left_id int, right_id int, topic string")
    cands, basis = gaps.conflict_candidates(c, 10)
    assert cands.count() == 1 and basis.first()["count"] == 3 and basis.first().prevalence == 0.3 and basis.first().dimension == "conflict"
    idea = planning.decompose("Using graph networks to detect floods in cities")
    q = planning.candidate_queries(idea, "missing pair", ["LoRA", "sea level"], "comparison")
    assert q and len(set(q)) == len(q) and all({"lora", "sea", "level"} <= set(x.split()) for x in q)


def test_headings_with_parents(spark):
    rows = [(1, 0, "2 Methods", "a"), (1, 1, "2.1 Data", "b"), (1, 2, "3.1 Odd", "c"), (1, 3, "Results", "d"), (1, 4, "2.2 Late", "e"), (2, 0, "Front matter", "f"), (2, 1, "Methods", "g")]
    sec = spark.createDataFrame(rows, "paper_id int, ord int, heading string, text string")
    got = [r.heading for r in documents.with_parents(sec).orderBy("paper_id", "ord").collect()]
    assert got == ["2 Methods", "2 Methods / 2.1 Data", "3.1 Odd", "Results", "2.2 Late", "Front matter", "Methods"]
    pages = spark.createDataFrame([(1, 0, "Page 1", "x"), (2, 0, "Page 1", "y")], "paper_id int, ord int, heading string, text string")
    out = documents.semantic_or_pages(sec, pages).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    assert {r.paper_id: r.n for r in out.collect()} == {1: 5, 2: 1}


def test_ablation_says_what_is_missing(spark):
    corpus = spark.createDataFrame([(i, f"river floods number {i}", "graph networks" if i % 2 else "trees") for i in range(8)], "id long, title string, abstract string")
    ideas = spark.createDataFrame([(1, "Using graph networks to detect river floods")], "idea_id long, text string")
    rows = ablation.variants(corpus, ideas).collect()
    assert {r.variant for r in rows if not r.available} == set(ablation.VARIANTS[2:]) and all(r.reason for r in rows if not r.available)
    model = spark.createDataFrame([(1, 0, "flood trees")], "idea_id long, ord int, text string")
    near = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(8)], "idea_id long, id long, semantic_raw_score double")
    full = ablation.variants(corpus, ideas, model, near).collect()
    assert {r.variant for r in full} == set(ablation.VARIANTS) and all(r.available for r in full)
