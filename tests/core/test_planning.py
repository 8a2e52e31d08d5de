import pytest

from siltstone.operators import planning as p
from siltstone.operators import retrieval


def test_facets():
    d = p.decompose("Detecting cancer using transformers among elderly patients in hospitals without labeled data")
    assert d["problem"] == ["Detecting cancer"] and d["intervention_or_method"] == ["transformers"] and d["population"] == ["elderly patients"]
    assert d["domain"] == ["hospitals"] and d["constraints"] == ["labeled data"]
    d = p.decompose("Using reinforcement learning to improve retrieval accuracy")
    assert d["intervention_or_method"] == ["reinforcement learning"] and d["outcomes"] == ["improve retrieval accuracy"] and d["problem"] == []
    d = p.decompose("Using transformers to detect pneumonia")
    assert d["problem"] == ["detect pneumonia"]
    d = p.decompose("graph networks for predicting floods with few samples from sensor data compared with LSTM")
    assert d["intervention_or_method"] == ["graph networks"] and d["problem"] == ["predicting floods"] and d["constraints"] == ["few samples"]
    assert d["data_or_modality"] == ["sensor data"] and d["comparison"] == ["LSTM"]
    assert p.decompose("tutoring for language learners")["population"] == ["language learners"]
    assert p.decompose("plain words only")["problem"] == ["plain words only"]
    with pytest.raises(ValueError):
        p.decompose("  ")


def test_synonyms_and_keywords():
    d = p.decompose("retrieval augmented generation (RAG) for QA")
    assert d["synonyms"] == {"retrieval augmented generation": ["RAG"]}
    assert "RAG" in d["keywords"] and len(d["keywords"]) <= 12 and "QA" in d["keywords"]


def test_queries():
    assert p.synonym_query({"low rank": ["LoRA", "lora", "Low  Rank"], "x": ["X"]}) == '("low rank" OR LoRA)'
    got = p.generate(p.decompose("Using graph networks to detect floods in cities"))
    assert got[0][1] == "original" and len({t.casefold() for t, _ in got}) == len(got) <= 6
    assert ("graph networks detect floods", "method_problem") in got and ("detect floods cities", "problem_context") in got
    assert p.generate({"original_text": "RAG"}) == [("RAG", "original")]
    with pytest.raises(ValueError):
        p.generate({"original_text": "RAG research"}, 7)
    v = p.verification_queries(p.decompose("Using graph networks to detect floods in cities"))
    assert v and all(2 <= len(q.split()) <= 24 for q in v) and len(set(v)) == len(v)
    assert p.requirement_groups(["RAG", "lora", "retrieval generation"], {"retrieval generation": ["RAG"]}) == [["RAG", "retrieval generation"], ["lora"]]


def test_over_tables(spark):
    ideas = spark.createDataFrame([(1, "Using graph networks (GN) to detect floods"), (2, None), (3, " ")], "idea_id long, text string")
    facets = p.decompose_ideas(ideas)
    assert [r.idea_id for r in facets.collect()] == [1]
    rows = p.generate_queries(facets).collect()
    assert {r.source for r in rows} == {"deterministic", "verification"} and rows[0].strategy == "original"


def test_plan(spark):
    idea = spark.createDataFrame([(1, "My idea here")], "idea_id long, text string")
    gen = [(1, i, f"det query {i}", "s", "deterministic") for i in range(3)] + [(1, 10 + i, f"llm query {i}", "s", "llm") for i in range(4)]
    gen += [(1, 20, "DET  query 0", "again", "llm"), (1, 21, "single", "s", "llm"), (1, 22, "my IDEA here", "s", "llm")]
    rows = retrieval.plan_queries(idea, spark.createDataFrame(gen, "idea_id long, ord int, text string, strategy string, source string")).orderBy("ord").collect()
    assert [r.text for r in rows] == ["My idea here", "det query 0", "det query 1", "llm query 0", "llm query 1", "llm query 2"]
    assert [len(r.origins) for r in rows] == [2, 2, 1, 1, 1, 1]


def test_early_stop(spark):
    rounds = [(1, 0, "alpha beta", ["A"], False), (1, 1, "beta alpha", ["a"], False), (1, 2, "alpha beta x", ["A"], False), (1, 3, "alpha beta", ["B"], False)]
    rounds += [(2, i, f"q{i} words", ["A"], False) for i in range(4)] + [(3, 0, "a b", [], False), (3, 1, "a b", [], True), (3, 2, "a b", [], False), (3, 3, "a b", [], False), (3, 4, "a b", [], False)]
    out = retrieval.adaptive_stop(spark.createDataFrame(rounds, "idea_id int, ord int, text string, ids array<string>, failed boolean"))
    ran = {}
    for r in out.orderBy("ord").collect():
        ran.setdefault(r.idea_id, []).append(r.executed)
    assert ran == {1: [True, True, True, False], 2: [True] * 4, 3: [True, True, True, True, False]}
