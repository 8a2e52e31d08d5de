import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import features as f
from siltstone.operators import documents, evaluation, evidence, gaps, landscape, operations, verification
from siltstone.sources import caches, jsonl, works


def test_frequencies_combinations_and_missing(spark):
    rows = [(i, i, "method", "LoRA") for i in range(3)] + [(0, 0, "method", "LoRA"), (3, 3, "method", "unknown"), (0, 0, "constraint", "few"), (1, 1, "constraint", "few"), (2, 2, "constraint", "few")]
    feats = spark.createDataFrame(rows, "paper_id int, ord int, dimension string, value string")
    papers = spark.createDataFrame([(0, 0, "empirical"), (1, 1, "methodological"), (2, 2, "review"), (3, 3, "empirical")], "paper_id int, ord int, study_type string")
    freq = {(r.dimension, r.value): r for r in landscape.frequencies(feats, papers).collect()}
    assert freq["method", "LoRA"]["count"] == 3 and freq["method", "LoRA"].prevalence == 0.75 and len(freq) == 2
    assert [r.paper_id for r in landscape.members(feats).where("value = 'LoRA'").orderBy("ord").collect()] == [0, 1, 2]
    (combo,) = landscape.combos(feats, papers, 2).collect()
    assert combo["count"] == 2 and combo.prevalence == 0.5 and landscape.N_SPECS == 210
    miss = {r.field: r.n_missing for r in landscape.missing_fields(feats, papers).collect()}
    assert miss["methods"] == 0 and miss["constraints"] == 1 and miss["datasets"] == 4


def _study(i, finding, kind="empirical", **more):
    base = dict(problems=["p", "q"], method_families=["m"], performance_metrics=["acc"], datasets=["d"], populations=[], baselines=[], constraints=[])
    return (i, i, kind, *(base | more).values(), [finding])


SCHEMA = "paper_id int, ord int, study_type string, problems array<string>, method_families array<string>, performance_metrics array<string>, datasets array<string>, populations array<string>, baselines array<string>, constraints array<string>, outcomes array<string>"


def test_conflicts(spark):
    run = lambda *rows: [(r.left_id, r.right_id, r.topic) for r in landscape.conflicts(spark.createDataFrame(list(rows), SCHEMA)).collect()]
    up, down = "it significantly outperforms", "it does not outperform"
    assert run(_study(1, up), _study(2, down)) == [(1, 2, "p")] == run(_study(2, up), _study(1, down))
    assert run(_study(1, "higher"), _study(2, "lower")) == []
    assert run(_study(1, up), _study(2, down, datasets=[])) == [] == run(_study(1, up), _study(2, down, "review"))
    assert run(_study(1, up, populations=["unknown"]), _study(2, down)) == [(1, 2, "p")]


def test_conflicts_on_a_grid_are_each_made_once(spark):
    """One key of many papers, papers that share several keys, and papers with findings of both kinds."""
    up, down = "it significantly outperforms", "it does not outperform"
    kinds = [[up], [down], [up, down], ["higher"]]
    rows = [(*_study(i, None, problems=["q", "p"][: 1 + i % 2], performance_metrics=["acc", "f1"][: 1 + i % 3 // 2], datasets=["d"] if i % 5 else ["e"])[:-1], kinds[i % 7 % 4]) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for x in rows:
        for y in rows:
            opposed = up in x[-1] and down in y[-1] or down in x[-1] and up in y[-1]
            if x[0] < y[0] and opposed and x[6] == y[6]:
                want.add((x[0], y[0], next(p for p in x[3] if p in y[3])) if set(x[3]) & set(y[3]) else None)
    for cell in (5, 10_000):
        got = [tuple(r) for r in landscape.conflicts(df, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want - {None}
    keyed = df.selectExpr("paper_id", "1 AS kp", "1 AS kf", "1 AS km", "IF(paper_id % 2 = 0, 1, -1) AS sign")
    a, b = landscape.on_grid(keyed, 5)
    met = a.join(b, ["kp", "kf", "km", "_r", "_c"]).groupBy("_r", "_c").count().collect()
    assert len(met) == 64 and sum(r["count"] for r in met) == 1600
    assert all(x.count() == 0 for x in landscape.on_grid(keyed.where("sign = 1"), 5))


def test_normalisers(spark):
    vals = ["Proposed model", "BERT models", "public datasets", "ImageNet dataset", "we propose this", "GPU Latency", "a", "Other thing", "42"]
    df = spark.createDataFrame([(x,) for x in vals], "v string")
    c = F.col("v")
    rows = df.select(f.method(c).alias("m"), f.dataset(c).alias("d"), f.problem(c).alias("p"), f.metric_kind(c).alias("k"), f.concrete_entity(c).alias("e")).collect()
    assert [r.m for r in rows][:2] == ["", "bert"] and [r.d for r in rows][2:4] == ["", "imagenet"] and rows[4].p == "" and rows[5].k == "efficiency" and rows[6].k == "performance"
    assert rows[7].e is False and rows[8].p == "" and rows[8].k is None
    guard = spark.createDataFrame([("few shot learning", "method", "few shot", "few shot"), ("few shot", "constraints", "Few-shot", "x"), ("n", "sample_size", "10 classes", ""), ("n", "sample_size", "10 classes", "of 50 images"), ("cross domain", "outcome", "good", "95%"), ("latency", "metrics", "latency", "5 ms time")], "c string, f string, v string, e string")
    assert [r[0] for r in guard.select(f.semantic_guard(*map(F.col, "cfve"))).collect()] == [False, True, False, True, False, True]


def test_ir_and_pairs(spark):
    ret = spark.createDataFrame([(1, 0, "noise"), (1, 1, " A"), (1, 2, "a"), (1, 3, "B")], "case_id int, ord int, id string")
    gold = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "z", 1), (3, "y", 0)], "case_id int, id string, grade int")
    m = {r.case_id: r for r in evaluation.ir_metrics(ret, gold).collect()}
    assert m[1].recall_10 == 1.0 and m[1].mrr == 0.5 and m[1].ndcg_10 < 1 and m[2].mrr == 0 and 3 not in m
    total = evaluation.macro(spark.createDataFrame([(1, 1.0)], "case_id int, mrr double"), spark.createDataFrame([(1,), (2,), (3,)], "case_id int"), ["mrr"]).first()
    assert (total.cases_total, total.cases_scored, total.mrr) == (3, 1, pytest.approx(1 / 3))
    pairs = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "case_id int, left string, right string")
    r = evaluation.pair_metrics(pairs([("A", "B"), ("C", "D")]), pairs([("B", " a"), ("A", "C"), ("a", "c")])).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1) and evaluation.bad_pairs(pairs([("x", "X "), ("", "y"), ("p", "q")])).count() == 2


def test_extraction_and_labels(spark):
    rows = lambda xs: spark.createDataFrame(xs, "case_id int, field string, value string")
    out = {r.field: r for r in evaluation.extraction_metrics(evaluation.extraction_counts(rows([(1, "m", "Lo-RA"), (2, "m", "x"), (2, "m", "y")]), rows([(1, "m", "lo ra"), (2, "m", "X")]))).collect()}
    assert (out["micro"].precision, out["micro"].recall, round(out["micro"].f1, 9)) == (1.0, pytest.approx(2 / 3), 0.8) and out["m"].exact_accuracy == 0.5
    cases = spark.createDataFrame([("well_studied", "promising_gap", ["a", "b", "c", "d", "e"], ["A "], []), ("uncertain", "uncertain", [], [], []), ("uncertain", None, [], [], [])], "expected string, predicted string, known array<string>, searched array<string>, confirmed array<string>")
    s = evaluation.verification_summary(cases).first()
    assert s.accuracy == pytest.approx(1 / 3) and s.discovery_rate == 0.2 and s.false_promising_count == 1 and s.cases_scored == 2
    lab = {r.label: r for r in evaluation.label_metrics(cases).collect()}
    assert lab["uncertain"].recall == 0.5 and lab["promising_gap"].fp == 1 and evaluation.confusion(cases).count() == 9
    claims = spark.createDataFrame([("Deep nets", "title", "The deep-nets", None), ("x", "full_text", "x", "x"), ("y", "abstract", "t", None)], "evidence_text string, source string, title string, abstract string")
    assert evaluation.attribution(claims).first().supported_claims == 1
    d = evaluation.counter_deltas(spark.createDataFrame([("a", 5, 3), ("b", None, 4)], "name string, before int, after int")).collect()
    assert [(r.name, r.delta) for r in d] == [("a", 0), ("b", 4)]


def test_operations(spark):
    asks = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "a"), ("d", 4, "c")], "day string, ord int, analysis_id string")
    assert {(r.ord, r.admitted) for r in operations.admit_budget(asks, 0.5, 0.25).collect()} == {(1, True), (2, True), (3, True), (4, False)}
    use = spark.createDataFrame([("a", 1000, 500, None), ("b", None, 5, None), ("b", 1, 1, None)], "analysis_id string, input_tokens int, output_tokens int, cost_usd double")
    assert {r.analysis_id: r.cost for r in operations.query_cost(operations.priced(use, 1.0, 2.0), 0.25).collect()} == {"a": pytest.approx(0.002), "b": 0.25}
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("k", t0 + dt.timedelta(hours=h), i) for i, h in enumerate([0, 1, 2, 24, 25])], "key string, ts timestamp, event_id int")
    # The window's old end belongs to it: the event after 24 hours still meets the first one.
    assert {r.event_id: r.admitted for r in operations.admitted(ev, 2, 86400).collect()} == {0: True, 1: True, 2: False, 3: False, 4: True}


def _claims(spark, rows):
    names = "paper_id int, field string, ord int, value string, canonical_value string, evidence_text string, source string, confidence double, section_id string, section_heading string, section_type string, role string, author_stated boolean"
    base = dict(paper_id=1, field="datasets", ord=0, value="v", canonical_value=None, evidence_text="deep nets", source="title", confidence=1.0, section_id=None, section_heading=None, section_type=None, role=None, author_stated=None)
    return spark.createDataFrame([tuple((base | {"ord": i} | r).values()) for i, r in enumerate(rows)], names)


def test_evidence(spark):
    papers = spark.createDataFrame([(1, "The Deep  Nets", "We compare deep nets against trees. A dataset of 1,200 images is used.")], "paper_id int, title string, abstract string")
    sections = spark.createDataFrame([(1, "s1", 0, "Methods", ["methods"], "deep nets here")], "paper_id int, section_id string, ord int, heading string, section_types array<string>, text string")
    full = dict(source="full_text", section_id="s1", section_heading="Methods", section_type="methods")
    m = dict(field="method_or_intervention")
    rows = [
        dict(value="ImageNet"), dict(value="image-net"), dict(value="public datasets"), dict(value="imagenet"), dict(value="lost", evidence_text="not there"), full | dict(value="ok"), full | dict(value="bad", section_heading="Other"),
        m | dict(value="LoRA", role="primary"), m | dict(value="data augmentation", role="primary"), m | dict(value="helper", role="supporting"), m | dict(value="SVM", role="comparison", source="abstract", evidence_text="against trees"),
        dict(field="comparison_or_baseline", value="lora"), dict(field="comparison_or_baseline", value="svm"), dict(field="constraints", value="LoRA"), dict(field="constraints", value="few labels"),
        dict(field="limitations", value="small", author_stated=True), dict(field="limitations", value="guess", author_stated=False), dict(field="future_work", value="more"),
    ]
    claims = _claims(spark, rows)
    assert {(r.failure, r.n) for r in evidence.rejections(evidence.with_failure(claims, papers, sections)).collect()} == {("unsupported_quotation", 1), ("incorrect_section_provenance", 1)}
    kept = {(r.field, r.value) for r in evidence.clean(claims, papers, sections).collect()}
    assert kept == {
        ("datasets", "ImageNet"), ("datasets", "image-net"), ("datasets", "ok"), ("method_or_intervention", "LoRA"), ("comparison_or_baseline", "SVM"), ("constraints", "few labels"), ("limitations", "small"), ("sample_size", "1,200 images")
    }
    moved = evidence.repair_provenance(claims.where("value in ('ok', 'lost')"), papers, False).collect()
    assert {(r.value, r.source, r.section_id, r.repaired) for r in moved} == {("ok", "title", None, True), ("lost", "title", None, False)}
    asked = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, False)], "paper_id int, has_abstract boolean, full_text_requested boolean")
    docs = spark.createDataFrame([(1, "usable"), (2, "fetch_failed")], "paper_id int, status string")
    got = {r.paper_id: (r.source_level, r.full_text_status, r.final_state) for r in evidence.coverage(asked, claims.withColumn("paper_id", F.when(F.col("ord") < 7, 1).otherwise(2)), docs).collect()}
    assert got == {1: ("full_text", "usable", "success"), 2: ("abstract_fallback", "fetch_failed", "success"), 3: ("none", "not_attempted", "failure")}


def test_documents(spark):
    body = "word " * 120
    html = f"<nav><p>no</p></nav><article><h1>Intro</h1><p>{body}<b>bold</b></p><ul><li>item</li></ul><aside><p>no</p></aside><h2>References</h2><p>[1]</p></article>"
    assert documents.html_sections(html) == [("Intro", body.strip() + " bold\nitem")] and documents.html_sections("<article><p>short</p></article>") == [] and documents.html_sections(None) == []
    xml = "<a xmlns='u'><abstract><p>Abs</p></abstract><sec><title>Methods</title><p>one</p><sec><title>References</title><p>x</p></sec></sec></a>"
    assert documents.xml_sections(xml) == [("Abstract", "Abs"), ("Methods", "one")] and documents.xml_sections("<broken") == [] and documents.xml_sections("<a><body>all</body></a>") == [("Full text", "all")]
    df = spark.createDataFrame([(1, "html", html), (2, "xml", xml), (3, "pdf", "x")], "paper_id long, source_format string, body string")
    parsed = documents.parse(df)
    assert [(r.paper_id, r.ord) for r in parsed.orderBy("paper_id", "ord").collect()] == [(1, 0), (2, 0), (2, 1)]
    out = documents.normalise(parsed, max_document=700, max_section=400).collect()
    assert [(r.section_id, len(r.text), r.truncated, r.section_types) for r in out] == [("section-0001", 400, True, ["other"])]
    plain = spark.createDataFrame([(5, 0, "Page 1", "x" * 90 + " " + "y" * 30)], "paper_id long, ord int, heading string, text string")
    assert [(r.section_id, len(r.text)) for r in documents.normalise(plain, max_chunk=50).orderBy("ord").collect()] == [("chunk-0001", 50), ("chunk-0002", 50), ("chunk-0003", 21)]
    lines = spark.createDataFrame([(1, "front\n1 Methods\nalpha\nbeta.\nRESULTS\ngamma\n2. This is a list item.\nReferences\nold")], "paper_id long, text string")
    assert [(r.heading, r.text) for r in documents.line_sessions(lines).orderBy("ord").collect()] == [("Front matter", "front"), ("1 Methods", "alpha\nbeta."), ("RESULTS", "gamma\n2. This is a list item.")]
    items = spark.createDataFrame([("q", i, c) for i, c in enumerate([50, 30, 10, 100, 5])], "queue string, ord int, chars int")
    assert [r.batch for r in documents.pack(items, 2, 110).orderBy("ord").collect()] == [0, 0, 1, 2, 3]
    loc = spark.createDataFrame([(1, 0, "a", "unknown", True, "usable"), (1, 1, "b", "pdf", True, "usable"), (2, 0, "c", "pdf", True, "fetch_failed"), (2, 1, "d", "pdf", True, "parse_failed"), (2, 2, "e", "pdf", False, "usable")], "paper_id int, ord int, url string, source_format string, is_open_access boolean, status string")
    assert {r.url for r in documents.choose_location(loc).collect()} == {"b", "d"}
    sec = spark.createDataFrame([(1, 1, "s1", "Other", ["other"], "z" * 50), (1, 2, "s2", "Methods", ["methods"], "m" * 80)], "paper_id int, ord int, section_id string, heading string, section_types array<string>, text string")
    assert [(r.section_id, len(r.text), r.cut) for r in documents.choose_context(sec, 120).collect()] == [("s1", 50, False)]
    assert [r.section_id for r in documents.choose_context(sec, 500, 1).collect()] == ["s2"]


def test_support_and_repetition(spark):
    rows = [(1, 1, "limitation", "small samples"), (2, 2, "limitation", "Small-samples"), (3, 3, "limitation", "small samples"), (3, 3, "limitation", "other"), (4, 4, "limitation", "cost")]
    mem = landscape.members(spark.createDataFrame(rows, "paper_id int, ord int, dimension string, value string"))
    assert [(r.value, r.n_papers) for r in gaps.repeated(mem, "limitation", 4).collect()] == [("small samples", 3)] and gaps.repeated(mem, "limitation", 1).count() == 0
    claims = [(1, "limitation", 0, "tiny samples", "only few samples"), (1, "limitation", 1, "samples", "x"), (1, "limitation", 2, "samples again", "x"), (4, "limitation", 0, "samples", "x"), (5, "method_family", 0, "LoRA models", "y"), (6, "method_family", 0, "lora", "y")]
    claims = spark.createDataFrame(claims, "paper_id int, dimension string, ord int, value string, evidence_text string")
    basis = spark.createDataFrame([("a", "limitation", "small samples"), ("a", "method_family", "LoRA"), ("b", "method_family", "GAN")], "candidate_id string, dimension string, value string")
    got = gaps.collect_support(basis, claims, mem, "direct_support")
    assert {(r.candidate_id, r.paper_id, r.value) for r in got.collect()} == {("a", 1, "tiny samples"), ("a", 1, "samples"), ("a", 5, "LoRA models"), ("a", 6, "lora")}
    cands = spark.createDataFrame([("a", "LoRA on small samples", ""), ("b", "GAN", "")], "candidate_id string, title string, description string")
    assert [(r.candidate_id, r.n_support) for r in gaps.gate(cands, got).collect()] == [("a", 3)]


def test_gap_pruning_and_consolidation(spark):
    rows = [("a", "c", "p", "t", "d", ["x=1", "y=2"], ["P1", "P2"], 0), ("b", "c", "p", "t2", "d", ["y=2", "x=1"], ["P1"], 0), ("e", "c", "p", "other", "d", ["x=1"], ["P1"], 0), ("f", "l", "q", "deep nets fail", "", [], ["P1", "P2"], 1), ("g", "l", "q", "nets fail", "", [], ["P9"], 0), ("h", "l", "q", "unrelated words", "", [], ["P8"], 0)]
    df = spark.createDataFrame(rows, "candidate_id string, category string, pattern_type string, title string, description string, keys array<string>, paper_ids array<string>, n_direct int")
    assert {r.candidate_id: r.root for r in gaps.consolidate(df).collect()} == {"a": "a", "b": "a", "e": "e", "f": "f", "g": "f", "h": "h"}
    rows = [("a", ["x", "y", "z"], 1.0, 2), ("b", ["x", "y"], 0.9, 2), ("c", ["u", "v"], 0.0, 0), ("d", ["w"], 0.0, 0), ("e", ["x", "y", "q"], 0.5, 3)]
    df = spark.createDataFrame([(i, "c", "p", k, s, m, 0.0, 0.0, 0, 2) for i, k, s, m in rows], "candidate_id string, category string, pattern_type string, keys array<string>, idea_anchor_score double, n_anchored int, idea_specificity double, specificity double, n_generic int, n_support int")
    assert {r.candidate_id for r in gaps.prune(df).collect()} == {"a", "d", "e"}


def test_verification(spark):
    pairs = [("reduced errors", "reduction of error rates", True), ("improving speed", "speed improvements", True), ("graph networks", "trees", False), ("other methods", "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", verification.phrase_matches(F.col("a"), F.col("b"))).collect())
    claims = spark.createDataFrame([(1, "method_or_intervention", "LoRA", "uses LoRA", "abstract"), (1, "research_objective", "flood prediction", "x", "abstract"), (2, "method_or_intervention", "LoRA", "y", "abstract"), (2, "datasets", "rivers", "z", "abstract")], "paper_id int, field string, value string, evidence_text string, source string")
    req = spark.createDataFrame([(7, "method", "g1", "lora"), (7, "method", "g1", "adapters"), (7, "problem", "g2", "the flood prediction")], "idea_id int, facet string, grp string, value string")
    met = verification.group_matches(claims, req)
    got = {r.paper_id: (r.facets, r.complete) for r in verification.match_strength(met, req).collect()}
    assert got == {1: (["method", "problem"], True), 2: (["method"], False)}
    cov = verification.coverage(met, req, spark.createDataFrame([(7, 2)], "idea_id int, n int")).first()
    assert cov.covered and cov.missing == []
    lab = spark.createDataFrame([(1, 0, 0, 1, 5, False, 5), (0, 0, 0, 1, 5, True, 5), (0, 0, 0, 0, 5, True, 5), (0, 0, 0, 0, 5, True, 1)], "direct int, partial int, potential int, failures int, n_papers int, covered boolean, n_landscape int")
    assert [r.label for r in verification.idea_label(lab).collect()] == ["well_studied", "uncertain", "promising_gap", "uncertain"]
    lab = spark.createDataFrame([(1, 5, 5, 5, 1, 0), (0, 5, 5, 5, 1, 0), (0, 5, 0, 0, 1, 0), (0, 0, 0, 0, 0, 0), (0, 5, 5, 5, 0, 1), (0, 5, 5, 5, 0, 0)], "failures int, n_papers int, n_records int, n_with_abstract int, confirmed int, potential int")
    assert [r.label for r in verification.candidate_label(lab).collect()] == ["uncertain", "well_studied", "uncertain", "uncertain", "uncertain", "promising_gap"]
    cands = spark.createDataFrame([("a", "combination_gap", 1.0), ("b", "comparable_conflict", 1.0), ("c", "combination_gap", 0.0)], "candidate_id string, pattern_type string, idea_anchor_score double")
    basis = spark.createDataFrame([("a", "method", "LoRA"), ("a", "problem", "flood prediction"), ("b", "conflict", "x"), ("c", "method", "LoRA"), ("c", "dataset", "rivers")], "candidate_id string, dimension string, value string")
    assert [r.candidate_id for r in verification.eligible(cands, basis).collect()] == ["a"]
    assert {(r.candidate_id, r.paper_id) for r in verification.observed(basis, claims).collect()} == {("a", 1), ("c", 2)}


def test_sources(spark, tmp_path):
    raw = [
        (0, '{"id": "https://openalex.org/W5", "display_name": " A  title ", "publication_year": 2020, "doi": "https://doi.org/10.1/X", "abstract_inverted_index": {"deep": [0, 2], "nets": [1]}, "cited_by_count": -3,'
            ' "referenced_works": ["W7", "https://openalex.org/w7", "bad"], "authorships": [{"author": {"display_name": "Ann Lee"}}, {"author": {}}],'
            ' "best_oa_location": {"is_oa": true, "landing_page_url": "https://x/a", "pdf_url": "https://x/a.pdf"}, "primary_location": {"is_oa": false, "pdf_url": "https://no"}, "locations": [{"is_oa": true, "pdf_url": "HTTPS://X/A.PDF/"}]}'),
        (1, '{"display_name": "", "publication_year": 99999}'), (2, "[1]"),
    ]
    a, b = works.parse_works(spark.createDataFrame(raw, "ord int, json string")).orderBy("ord").collect()
    assert (a.id, a.title, a.abstract, a.citation_count, a.authors, a.referenced_work_ids) == ("https://openalex.org/W5", "A title", "deep nets deep", 0, ["Ann Lee"], ["https://openalex.org/W7"])
    assert [(x.url, x.source_format) for x in a.full_text_locations] == [("https://x/a.pdf", "pdf"), ("https://x/a", "unknown")]
    assert b.title == "Untitled" and b.publication_year is None and b.id.startswith("openalex:synthetic:") and b.abstract is None
    path = tmp_path / "cases.jsonl"
    path.write_text('{"_meta": {"v": 1}}\n{"id": "a", "n": 1}\n\n{"id": "a", "n": 2}\noops\n{"n": 3}\n')
    good, bad = jsonl.load(spark, str(path), "id string, n int", "id")
    assert [(r.line, r.id, r.n) for r in good.collect()] == [(2, "a", 1)] and {(r.line, r.reason) for r in bad.collect()} == {(4, "duplicate key"), (5, "malformed"), (6, "missing key")}
    assert jsonl.meta(spark, str(path)).count() == 1
    jsonl.write(good.select("id", F.lit(None).cast("int").alias("x")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"id":"a","x":null}'
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", "old", t0), ("k", "new", t0 + dt.timedelta(hours=1)), ("z", "x", t0)], "key string, v string, stored_at timestamp")
    now = F.lit(t0 + dt.timedelta(hours=2))
    assert [r.v for r in caches.fresh(caches.latest(rows, ["key"]), now, 2 * 3600).collect()] == ["new"]
    assert {r.key for r in caches.misses(spark.createDataFrame([("k",), ("q",), ("q",)], "key string"), rows, ["key"]).collect()} == {"q"}
