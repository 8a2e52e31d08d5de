import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import gaps, landscape, planning, verification

CLAIMS = "paper_id int, field string, value string, evidence_text string, source string"
DIMENSION = {
    "research_objective": "problem", "method_or_intervention": "method_family", "datasets": "dataset", "comparison_or_baseline": "baseline", "constraints": "constraint",
    "population_or_setting": "population_or_setting", "main_findings": "outcome", "limitations": "limitation", "future_work": "future_work",
}


def claims_of(spark, *rows):
    """Claims (paper_id, field, value, evidence_text), also by dimension and with a place in the paper."""
    df = spark.createDataFrame([(*r, "abstract") for r in rows], CLAIMS)
    names = F.create_map(*[F.lit(x) for pair in DIMENSION.items() for x in pair])
    return df.withColumn("dimension", F.element_at(names, F.col("field"))).withColumn("ord", F.monotonically_increasing_id())


def pairs(df):
    return {tuple(r) for r in df.collect()}


# --- words -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        # Words that only gap generation takes for generic are concepts here.
        ("graph model", "graph baseline", False),
        ("model", "the model", True),
        ("dataset", "setting", False),
        ("approach to floods", "approach floods", True),
        ("unknown", "unknown", False),
        ("other methods", "floods", False),
        ("none of the models", "floods models", True),
    ],
)
def test_concepts_have_their_own_generic_words(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(verification.phrase_matches(F.col("a"), F.col("b"))).first()[0] is want


def test_search_terms_equal_those_of_verification(spark):
    texts = ["Other methods of graph-models", "the unknown population", "A deep_net's data", "none", "", "misc baselines vs LoRA"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.t for r in df.select("i", verification.terms(F.col("x")).alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == [planning.search_terms(x) for x in texts]


def test_study_actions_are_verbs_of_doing():
    said = lambda x: bool(re.search(verification.STUDY_ACTION, x))
    assert all(map(said, ["we assess it", "Deployed here", "was replicated", "compare both", "implemented"]))
    assert not any(map(said, ["a study", "experimental results", "evaluation", "testing", "investigates"]))


# --- searches ----------------------------------------------------------------------------------------------


def test_candidate_queries_by_pattern():
    idea = planning.decompose("Using graph networks to detect floods in cities")
    got = planning.candidate_queries(idea, "LoRA for sea level", ["LoRA", "sea level"], "combination_gap")
    assert got == [
        "lora sea level graph networks detect floods cities joint study evaluation",
        "lora sea level lora sea level detect floods joint study evaluation",
        "lora sea level graph networks joint study evaluation",
    ]
    assert planning.candidate_queries(idea, "x", ["LoRA"], "no such pattern")[0].endswith("direct evaluation")
    # A basis without a term leaves the title to be kept; a query that cannot keep its basis within its terms goes.
    assert all("rivers" in q for q in planning.candidate_queries(idea, "rivers", ["unknown"], "comparable_conflict"))
    assert planning.candidate_queries(idea, "x", [" ".join(f"w{i}" for i in range(30))]) == []
    with pytest.raises(ValueError):
        planning.candidate_queries(idea, "x", ["y"], limit=4)


# --- counterexamples ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def records(spark):
    return claims_of(
        spark,
        # 1: about the idea; a comparison with a baseline. 2: not about the idea, but alike.
        (1, "research_objective", "flood detection", "we detect floods"), (1, "method_or_intervention", "LoRA", "LoRA is used"), (1, "comparison_or_baseline", "trees", "against trees"),
        (2, "research_objective", "sea ice", "ice"), (2, "method_or_intervention", "LoRA", "LoRA is used"), (2, "comparison_or_baseline", "trees", "against trees"),
        # 3: both as methods, and a finding that compares them by name. 4: both as methods, nothing compared.
        (3, "research_objective", "flood detection", "x"), (3, "method_or_intervention", "LoRA", "one"), (3, "method_or_intervention", "trees", "two"), (3, "main_findings", "LoRA outperforms trees", "in all"),
        (4, "research_objective", "flood detection", "x"), (4, "method_or_intervention", "LoRA", "one"), (4, "method_or_intervention", "trees", "two"), (4, "main_findings", "floods rise", "fast"),
        # 5: resolves a limitation. 6: repeats it. 7: settles a conflict on floods. 8: only speaks of it.
        (5, "research_objective", "flood detection", "x"), (5, "main_findings", "small samples", "we evaluated small samples of rivers"),
        (6, "research_objective", "flood detection", "x"), (6, "limitations", "small samples", "we evaluated only small samples"),
        (7, "research_objective", "flood detection", "x"), (7, "main_findings", "floods vary", "heterogeneity explains it"),
        (8, "research_objective", "flood detection", "x"), (8, "main_findings", "floods vary", "that is all"),
    )


def _idea(spark):
    return spark.createDataFrame([("problem", "flood detection"), ("domain", "ice")], "facet string, value string")


def test_topic_gate(spark, records):
    assert {r.paper_id for r in verification.topic_papers(_idea(spark), records).collect()} == {1, 3, 4, 5, 6, 7, 8}
    method = spark.createDataFrame([("intervention_or_method", "trees"), ("problem", "unknown")], "facet string, value string")
    assert {r.paper_id for r in verification.topic_papers(method, records).collect()} == {3, 4}
    bare = spark.createDataFrame([("constraints", "x")], "facet string, value string")
    terms = F.array(F.lit("ice"), F.lit("rivers"))
    titles = spark.createDataFrame([(8, "On ice"), (99, "on ice")], "paper_id int, title string")
    assert {r.paper_id for r in verification.topic_papers(bare, records, terms, titles).collect()} == {2, 5, 8, 99}
    assert verification.topic_papers(bare, records).count() == 0


def test_direct_counterexamples_by_pattern(spark, records):
    candidates = spark.createDataFrame(
        [
            ("pair", "combination_gap", "t"), ("compared", "missing_comparison", "t"), ("limit", "repeated_limitation", "t"), ("titled", "evaluation_gap", "small samples"),
            ("conflict", "comparable_conflict", "Conditions behind conflicting findings on floods"), ("narrow", "narrow_dataset_setting", "t"), ("odd", "something", "floods"),
        ],
        "candidate_id string, pattern_type string, title string",
    )
    basis = spark.createDataFrame(
        [
            ("pair", "problem", "flood detection"), ("pair", "method_family", "LoRA"), ("compared", "method_family", "LoRA"), ("compared", "method_family", "trees"),
            ("limit", "limitation", "small samples"), ("titled", "baseline", "floods"), ("narrow", "dataset_type", "image"), ("odd", "problem", "flood detection"),
        ],
        "candidate_id string, dimension string, value string",
    )
    got = pairs(verification.direct_counterexamples(candidates, basis, records, verification.topic_papers(_idea(spark), records)))
    assert got == {("pair", 1), ("pair", 3), ("pair", 4), ("compared", 1), ("compared", 3), ("limit", 5), ("titled", 5), ("conflict", 7)}
    everywhere = records.select("paper_id").distinct()
    assert pairs(verification.direct_counterexamples(candidates, basis, records, everywhere)) - got == {("compared", 2)}


def test_contextual_and_title_matches(spark, records):
    candidates = spark.createDataFrame([("a", "combination_gap", "x", ""), ("b", "comparable_conflict", "methods of heterogeneity in floods", "")], "candidate_id string, pattern_type string, title string, description string")
    basis = spark.createDataFrame([("a", "method_family", "LoRA"), ("a", "dataset", "maps")], "candidate_id string, dimension string, value string")
    topical = verification.topic_papers(_idea(spark), records)
    # Of b's terms methods is generic; two others must stand in the record.
    assert pairs(verification.contextual(candidates, basis, records, topical)) == {("a", 1), ("a", 3), ("a", 4), ("b", 7)}
    titles = spark.createDataFrame([(1, "LoRA on maps"), (2, "LoRA"), (3, "floods and heterogeneity of methods"), (4, "floods")], "paper_id int, title string")
    assert pairs(verification.title_matches(candidates, basis, titles)) == {("b", 3)}
    assert pairs(verification.title_matches(candidates.withColumn("title", F.lit("")), basis, titles)) == {("a", 1)}
    assert pairs(verification.idea_title_matches(F.array(F.lit("floods"), F.lit("methods")), titles)) == {(3,)}


def test_observed_needs_value_and_evidence_in_the_role(spark, records):
    basis = spark.createDataFrame([("x", "problem", "flood detection"), ("x", "baseline", "trees"), ("y", "method", "LoRA"), ("z", "problem", "ice"), ("z", "method", "unknown")], "candidate_id string, dimension string, value string")
    assert pairs(verification.observed(basis, records)) == {("x", 1)}


def test_labels_are_applied(spark):
    cands = spark.createDataFrame([("a",), ("b",)], "candidate_id string")
    labels = spark.createDataFrame([("a", "uncertain")], "candidate_id string, label string")
    against = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2)], "candidate_id string, paper_id int")
    got = {r.candidate_id: (r.final_label, r.contradicting_paper_ids) for r in verification.apply_labels(cands, labels, against).collect()}
    assert got == {"a": ("uncertain", [1, 2]), "b": (None, None)}


def test_the_cap_keeps_the_order_of_priority(spark):
    rows = [(f"c{i}", "combination", "combination_gap", [f"k{i}", f"m{i}"], 1.0, 2 - i % 2, float(i % 3), 0.0, 0, 2) for i in range(8)]
    schema = "candidate_id string, category string, pattern_type string, keys array<string>, idea_anchor_score double, n_anchored int, idea_specificity double, specificity double, n_generic int, n_support int"
    df = spark.createDataFrame(rows, schema)
    seen = spark.createDataFrame([("c5", 1)], "candidate_id string, paper_id int")
    # By specificity to the idea first, then by matches: 2 and 5 (2.0), then 1, 4, 7 (1.0).
    got = [r.candidate_id for r in verification.select_for_verification(df, df, seen, 4).collect()]
    assert sorted(got) == ["c2", "c4", "c1"] or sorted(got) == sorted(["c2", "c4", "c1"])
    assert "c5" not in got and len(got) == 3


# --- prescreening ------------------------------------------------------------------------------------------


def test_prescreen(spark):
    papers = spark.createDataFrame([(1, 1, "Flood detection", "by graph models"), (1, 2, "Floods", None), (1, 3, "Ice", "x"), (1, 4, "Ice", "y"), (2, 5, "alone", "z"), (3, 6, "a", "b"), (3, 7, "c", "d")], "idea_id int, paper_id int, title string, abstract string")
    need = spark.createDataFrame([(1, "p", "flood detection"), (1, "m", "graph model"), (1, "m", "trees"), (2, "p", "alone")], "idea_id int, grp string, value string")
    scores = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.75), (1, 4, 0.7)], "idea_id int, paper_id int, score double")
    got = {r.paper_id: (r.n_covered, r.verdict) for r in verification.prescreen(papers, need, scores).collect()}
    assert got == {1: (2, "accepted"), 2: (0, "uncertain"), 3: (0, "uncertain"), 4: (0, "rejected"), 5: (1, "uncertain"), 6: (0, "uncertain"), 7: (0, "uncertain")}


# --- candidates --------------------------------------------------------------------------------------------


def _members(spark, claims):
    rows = claims.where("dimension is not null").selectExpr("paper_id", "paper_id as ord", "dimension", "lower(value) as value").distinct()
    return rows, landscape.members(rows), landscape.frequencies(rows, rows.select("paper_id").distinct())


def test_anchors_and_strong_context(spark):
    claims = claims_of(
        spark,
        (1, "research_objective", "flood detection", "x"), (1, "method_or_intervention", "LoRA", "x"), (1, "datasets", "maps", "x"),
        (2, "research_objective", "flood detection", "x"), (2, "datasets", "gauges", "x"), (2, "limitations", "few gauges", "too few"),
        (3, "method_or_intervention", "LoRA", "x"), (3, "datasets", "radar", "x"), (4, "datasets", "radar", "x"), (5, "research_objective", "flood detection", "x"), (5, "datasets", "photos", "x"),
        (6, "research_objective", "flood detection", "x"), (6, "datasets", "photos", "x"),
    )
    idea = spark.createDataFrame([("problem", "flood detection"), ("method", "LoRA model")], "dimension string, value string")
    anchors = gaps.record_anchors(claims, idea, F.array(F.lit("x")))
    assert pairs(anchors) == {(1, True), (2, False), (3, False), (5, False), (6, False)}
    _, members, freq = _members(spark, claims)
    got = {r.value: r.strong for r in gaps.strong_context(freq.where("dimension = 'dataset'"), members, claims, anchors).collect()}
    # maps by a paper with problem and method, gauges by a limitation, photos by two papers; radar has one anchored paper alone.
    assert got == {"maps": True, "gauges": True, "radar": False, "photos": True}
    nothing = spark.createDataFrame([("constraint", "y")], "dimension string, value string")
    titles = spark.createDataFrame([(4, "radar x"), (9, "radar")], "paper_id int, title string")
    assert pairs(gaps.record_anchors(claims, nothing, F.array(F.lit("radar")), titles)) == {(3, False), (4, False), (9, False)}


def test_relevance_of_a_basis(spark):
    rows = [("a", True, False), ("a", False, True), ("b", True, False), ("b", False, False), ("c", False, True), ("d", False, True), ("d", False, True), ("e", False, False), ("f", True, False)]
    df = spark.createDataFrame(rows, "candidate_id string, anchored boolean, strong boolean")
    assert {r.candidate_id for r in gaps.relevant(df).collect()} == {"a", "c", "f"}


def test_comparisons_need_a_reason(spark):
    claims = claims_of(
        spark,
        (1, "method_or_intervention", "LoRA", "x"), (2, "method_or_intervention", "LoRA", "x"), (1, "method_or_intervention", "trees", "x"), (3, "method_or_intervention", "trees", "x"),
        (4, "method_or_intervention", "kernels", "x"), (5, "method_or_intervention", "kernels", "x"), (6, "method_or_intervention", "waves", "x"), (7, "method_or_intervention", "waves", "x"),
        (8, "comparison_or_baseline", "others", "kernels versus LoRA"), (9, "comparison_or_baseline", "others", "waves and LoRA"),
    )
    idea = spark.createDataFrame([("comparison", "LoRA against waves"), ("method", "trees kernels")], "dimension string, value string")
    _, members, freq = _members(spark, claims)
    freq = freq.withColumn("strong", F.lit(True)).withColumn("anchored", F.lit(True))
    reasons = gaps.justified_pairs(claims, idea)
    assert pairs(reasons) == {("lora", "waves"), ("kernels", "lora")}
    missing = gaps.missing_comparisons(freq, gaps.observed_pairs(claims), reasons)
    assert {(r.left, r.right) for r in missing.collect()} == {("lora", "waves"), ("kernels", "lora")}
    seen = claims.unionByName(claims_of(spark, (1, "comparison_or_baseline", "waves", "x")))
    assert {(r.left, r.right) for r in gaps.missing_comparisons(freq, gaps.observed_pairs(seen), gaps.justified_pairs(seen, idea)).collect()} == {("kernels", "lora")}
    rows, basis = gaps.comparison_builder(claims_of(spark, (1, "comparison_or_baseline", "a", "x"), (2, "comparison_or_baseline", "b", "x")).unionByName(claims), members.unionByName(_members(spark, claims_of(spark, (1, "comparison_or_baseline", "a", "x"), (2, "comparison_or_baseline", "b", "x")))[1]), freq, idea)
    assert {r.title for r in rows.collect()} == {"Matched comparison of lora and waves", "Matched comparison of kernels and lora"} and basis.count() == 4


def test_narrow_setting(spark):
    schema = "dimension string, value string, count long, prevalence double"
    one = spark.createDataFrame([("dataset_type", "image", 3, 0.5), ("dataset_type", "text", 1, 0.1), ("dataset", "maps", 9, 1.0)], schema)
    assert [r.value for r in gaps.narrow_setting(one, 5).collect()] == ["image"]
    assert gaps.narrow_setting(one, 6).count() == 0
    two = one.withColumn("count", F.lit(2).cast("long"))
    assert gaps.narrow_setting(two, 2).count() == 0


def test_texts_by_dimension_pair(spark):
    pair = lambda *d: [(a, b) for a, b in d]
    rows = [
        (pair(("problem", "floods"), ("method_family", "LoRA")), "LoRA for floods"),
        (pair(("method_family", "LoRA"), ("dataset", "maps")), "LoRA evaluated with maps"),
        (pair(("method_family", "LoRA"), ("constraint", "few labels")), "LoRA under few labels"),
        (pair(("method_family", "LoRA"), ("population_or_setting", "cities")), "LoRA in cities"),
        (pair(("problem", "floods"), ("dataset", "maps")), "Combination of floods and maps"),
        (pair(("problem", "a"), ("dataset", "b"), ("constraint", "c")), "Combination of a + b + c"),
    ]
    df = spark.createDataFrame(rows, "dims array<struct<dimension:string,value:string>>, want string")
    got = df.select("want", gaps.combination_text(0).alias("title"), gaps.combination_text(1).alias("text")).collect()
    assert all(r.title == r.want for r in got) and all("analyzed" in r.text for r in got)


def test_generation_from_records(spark):
    """Four papers: a repeated limitation, a combination that no paper shows, and a conflict; each with two supporting papers."""
    claims = claims_of(
        spark,
        (1, "research_objective", "flood detection", "flood detection"), (1, "method_or_intervention", "LoRA", "LoRA"), (1, "datasets", "river maps", "river maps"), (1, "limitations", "sparse gauges", "sparse gauges"), (1, "main_findings", "flood detection improves", "x"),
        (2, "research_objective", "flood detection", "flood detection"), (2, "method_or_intervention", "LoRA", "LoRA"), (2, "datasets", "river maps", "river maps"), (2, "limitations", "Sparse gauges", "sparse gauges"), (2, "main_findings", "flood detection worsens", "x"),
        (3, "research_objective", "flood detection", "flood detection"), (3, "method_or_intervention", "trees", "trees"), (3, "constraints", "low power", "low power"),
        (4, "research_objective", "flood detection", "flood detection"), (4, "method_or_intervention", "trees", "trees"), (4, "constraints", "low power", "low power"),
    )
    rows, members, freq = _members(spark, claims)
    idea = spark.createDataFrame([("problem", "flood detection"), ("method", "LoRA"), ("constraint", "low power")], "dimension string, value string")
    terms = F.array(*map(F.lit, ("flood", "detection", "lora", "low", "power")))
    conflicts = spark.createDataFrame([(1, 2, "flood detection")], "left_id int, right_id int, topic string")
    found, basis, support = gaps.generate(rows, 4, freq, members, claims, idea, terms, conflicts, limit=50)
    by = {}
    for r in found.orderBy("rank").collect():
        by.setdefault(r.pattern_type, []).append(r)
    assert set(by) == {"combination_gap", "repeated_limitation", "comparable_conflict"}
    titles = {r.title for r in by["combination_gap"]}
    # Two papers show the three together; with low power nobody does.
    assert {"lora under low power", "Combination of flood detection + lora + river maps + low power"} <= titles and "Combination of flood detection + lora + river maps" not in titles
    assert [r.title for r in by["repeated_limitation"]] == ["Repeated author-stated limitation: sparse gauges"]
    assert [r.title for r in by["comparable_conflict"]] == ["Conditions behind conflicting findings on flood detection"]
    ranks = [(r.rank, -r.n_support, r.pattern_type) for rs in by.values() for r in rs]
    assert [k for k, *_ in sorted(ranks)] == list(range(1, len(ranks) + 1)) and [x[1:] for x in sorted(ranks)] == sorted(x[1:] for x in ranks)
    pair = next(r for r in by["combination_gap"] if r.title == "lora under low power")
    assert pair.idea_anchor_score == 1.0 and pair.n_support == 4
    assert {(r.dimension, r.value) for r in basis.where(F.col("candidate_id") == pair.candidate_id).collect()} == {("method_family", "lora"), ("constraint", "low power")}
    assert {r.paper_id for r in support.where(F.col("candidate_id") == pair.candidate_id).collect()} == {1, 2, 3, 4}
    few, _, _ = gaps.generate(rows, 4, freq, members, claims, idea, terms, conflicts, limit=2)
    assert few.count() == 2
    with pytest.raises(ValueError):
        gaps.generate(rows, 4, freq, members, claims, idea, terms, limit=0)


def test_consolidation_without_basis_is_greedy_by_title(spark):
    rows = [("a", "c", "p", "alpha beta gamma", "", ["1"], 0), ("b", "c", "p", "alpha beta delta", "", ["2"], 3), ("d", "c", "p", "omega", "", ["1", "7"], 0), ("e", "c", "p", "psi", "", ["1", "7"], 1), ("f", "c", "q", "alpha beta gamma", "", ["1"], 0)]
    df = spark.createDataFrame([(i, c, p, t, d, [], ids, n) for i, c, p, t, d, ids, n in rows], "candidate_id string, category string, pattern_type string, title string, description string, keys array<string>, paper_ids array<string>, n_direct int")
    # b joins a (two of three terms) and is the stronger; e joins d by two papers and is the stronger.
    assert {r.candidate_id: r.root for r in gaps.consolidate(df).collect()} == {"a": "b", "b": "b", "d": "e", "e": "e", "f": "f"}


def test_unique_basis_and_landscape_helpers(spark):
    basis = spark.createDataFrame([("a", 0, "problem", "Flood-detection"), ("a", 1, "problem", "flood detection"), ("a", 2, "method", "flood detection")], "candidate_id string, ord int, dimension string, value string")
    assert sorted(r.ord for r in gaps.unique_basis(basis).collect()) == [0, 2]
    evidence = spark.createDataFrame([("W1", "w1", 3, 0.5, 1), ("W2", "W1", 3, 0.9, 2), ("W3", "w2", 1, 0.1, 3)], "paper_id string, canonical_id string, n_values int, confidence double, ord int")
    assert sorted(r.paper_id for r in landscape.richest_evidence(evidence).collect()) == ["W2", "W3"]
    same = spark.createDataFrame([("w1", "C1"), ("W2", "C1"), ("W2", "C2")], "paper_id string, canonical_id string")
    got = {r.paper_id: r.canonical_id for r in landscape.canonical_evidence(evidence.drop("canonical_id"), same).collect()}
    assert got == {"W1": "C1", "W2": "W2", "W3": "W3"}
    papers = spark.createDataFrame([(1,), (2,)], "paper_id int")
    scored = landscape.with_relevance(papers, spark.createDataFrame([(1, 0.5)], "paper_id int, final_score double"))
    assert {r.paper_id: r.relevance_score for r in scored.collect()} == {1: 0.5, 2: None}


def test_more_than_96_combinations_enter_where_50_are_asked(spark, monkeypatch):
    dims = ("problem", "population_or_setting", "method_family", "dataset", "baseline")
    rows = spark.createDataFrame([(f"{d}{i}{n}", d, f"{d} value {i}", n) for d in dims for i in range(4) for n in range(2)], "paper_id string, dimension string, value string, ord int")
    anchored = rows.groupBy("dimension", "value").agg(F.count("*").alias("count")).withColumn("anchored", F.lit(True))
    assert gaps.combination_candidates(anchored, rows, 400).count() == 400
    asked = []
    real = gaps.combination_builder
    monkeypatch.setattr(gaps, "combination_builder", lambda f, v, limit: asked.append(limit) or real(f, v, limit))
    claims = claims_of(spark, (1, "research_objective", "floods", "floods"), (2, "research_objective", "floods", "floods"))
    found, members, freq = _members(spark, claims)
    idea = spark.createDataFrame([("problem", "floods")], "dimension string, value string")
    for limit in (50, 3):
        gaps.generate(found, 2, freq, members, claims, idea, F.array(F.lit("floods")), limit=limit)
    assert asked == [400, 24]


def test_concepts_are_found_once_a_wording(spark):
    claims = claims_of(spark, *[(i, "research_objective", f"flood {i % 2}", "floods") for i in range(20)])
    said = verification._wordings(claims).where(F.size("have") > 0)
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan and said.count() == 2
    req = spark.createDataFrame([(1, "problem", "p", "flood 1")], "idea_id int, facet string, grp string, value string")
    met = verification.group_matches(claims, req)
    assert {r.paper_id for r in met.collect()} == set(range(1, 20, 2))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _greedy(rows, threshold):
    """What stays, by a loop over the order of priority."""
    out = {}
    for group in {r["pattern_type"] for r in rows}:
        kept = []
        mine = [r for r in rows if r["pattern_type"] == group and (len(r["keys"]) <= 1 or r["idea_anchor_score"] > 0)]
        for place, r in enumerate(sorted(mine, key=lambda r: (-r["idea_anchor_score"], -len(r["keys"]), -r["n_anchored"], r["candidate_id"])), 1):
            keys = set(r["keys"])
            if not any(keys and k and ((keys < k and m >= r["n_anchored"]) or len(keys & k) / len(keys | k) >= threshold) for k, m in kept):
                kept.append((keys, r["n_anchored"]))
                out[r["candidate_id"]] = place
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.75), (2, 0.75), (3, 0.5)])
def test_pruning_in_rounds_equals_a_loop(spark, seed, threshold):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        keys = rng.sample([f"d={c}" for c in "abcdefghijkl"], rng.choice([0, 1, 2, 2, 3, 3, 4, 5]))
        rows.append({"candidate_id": f"c{i:03d}", "category": "x", "pattern_type": f"p{i % 2}", "keys": keys, "idea_anchor_score": rng.choice([0.0, 0.5, 1.0]), "n_anchored": rng.randint(0, 2)})
    schema = "candidate_id string, category string, pattern_type string, keys array<string>, idea_anchor_score double, n_anchored int"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0) for c in ("idea_specificity", "n_generic", "specificity", "n_support")})
    assert {r.candidate_id: r.place for r in gaps.prune(df, threshold).collect()} == _greedy(rows, threshold)
    assert gaps.prune(df.limit(0)).count() == 0


def test_pruning_meets_candidates_by_rare_keys(spark):
    """All share one key; what each meets besides it is its own neighbour, so links do not grow with the square."""
    rows = [(f"c{i:04d}", ["all", f"own{i // 2}", f"more{i // 2}"], i) for i in range(2000)]
    df = spark.createDataFrame(rows, "candidate_id string, keys array<string>, i int")
    ranked = df.select(F.col("i").cast("long").alias("c"), F.lit("g").alias("grp"), F.col("i").alias("place"), "keys", F.lit(0).alias("m"))
    links = gaps._dominance(ranked, 0.75)
    assert links.count() == 1000
