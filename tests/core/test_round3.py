from pyspark.sql import functions as F

from siltstone.operators import documents, evaluation, gaps, landscape


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _studies(spark, several):
    up, down = "it outperforms the others", "it does not outperform the others"
    rows = []
    for i in range(40):
        sets = [[], ["d1"], ["d2"]][i % 3], [[], ["p"]][i % 2]
        if several and i % 4 == 0:
            sets = (["d1", "d2"], ["p", "q"])
        rows.append((i, i, "empirical", ["a", "b"] if several and i % 5 == 0 else ["a"], ["f"], ["m"], *sets, [], ["unknown"], [up, down] if i % 10 == 0 else [up] if i % 7 else [down]))
    arrays = ("problems", "method_families", "performance_metrics", "datasets", "populations", "baselines", "constraints", "outcomes")
    return rows, spark.createDataFrame(rows, "paper_id int, ord int, study_type string, " + ", ".join(f"{a} array<string>" for a in arrays))


def _brute(rows):
    agree = lambda x, y: (not x and not y) or bool(set(x) & set(y))
    out = set()
    for a in rows:
        for b in rows:
            if a[1] < b[1] and set(a[3]) & set(b[3]) and agree(a[6], b[6]) and agree(a[7], b[7]):
                if any(x != y for x in a[10] for y in b[10]):
                    out.add((a[0], b[0]))
    return out


def test_conflicts_compare_only_studies_that_agree_on_single_values(spark):
    rows, df = _studies(spark, False)
    found = landscape.conflicts(df, 7)
    assert "arrays_overlap" not in _plan(found)
    assert sorted((r.left_id, r.right_id) for r in found.collect()) == sorted(_brute(rows))
    rows, df = _studies(spark, True)
    assert sorted((r.left_id, r.right_id) for r in landscape.conflicts(df, 7).collect()) == sorted(_brute(rows))


def test_extraction_counts_need_no_join_and_no_second_shuffle(spark):
    rows = [(i % 5, "m", f"v{i % 4}", i % 2 == 0, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "case_id int, field string, value string, gold boolean, predicted boolean")
    dealt = df.repartition(3, "case_id")
    got = evaluation.marked_counts(dealt)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got) == key(evaluation.extraction_counts(df.where("gold").drop("gold", "predicted"), df.where("predicted").drop("gold", "predicted")))
    want = {}
    for c in range(5):
        g, p = ({v for i, _, v, *s in rows if i == c and s[n]} for n in (0, 1))
        want[c] = (len(g & p), len(p - g), len(g - p))
    assert {r.case_id: (r.tp, r.fp, r.fn) for r in got.collect()} == want


def test_parsed_sections_are_sent_on_in_small_parts(spark, monkeypatch):
    pages = [(i, "html", "<article>" + "".join(f"<h2>Part {j}</h2><p>{'word ' * 60}</p>" for j in range(3)) + "</article>") for i in range(30)]
    df = spark.createDataFrame(pages, "paper_id long, source_format string, body string").coalesce(1)
    whole = sorted(map(tuple, documents.parse(df).collect()))
    monkeypatch.setattr(documents, "PARSED_CHARS", 500)
    assert sorted(map(tuple, documents.parse(df).collect())) == whole and len(whole) >= 90
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= documents.PARSED_ROWS


def test_held_values_and_pairs_of_sets_equal_those_of_rows(spark):
    rows = [(i, d, f"{d}{(i * k) % 4}" if i % 9 else "none") for i in range(30) for k, d in ((1, "method_family"), (3, "dataset"), (5, "baseline"))] + [(3, "dataset", "dataset7"), (4, "baseline", None)]
    long = spark.createDataFrame(rows, "paper_id int, dimension string, value string").distinct()
    papers = spark.createDataFrame([(i, "empirical" if i % 3 else "survey") for i in range(30)], "paper_id int, study_type string")
    sets = long.groupBy("paper_id").agg(F.collect_list(F.struct("dimension", "value")).alias("feats")).join(papers, "paper_id", "left")
    top = spark.createDataFrame([("method_family", "method_family1"), ("dataset", "dataset1"), ("dataset", "dataset7")], "dimension string, value string")
    key = lambda df: sorted(map(str, df.collect()))
    found = gaps.held_values(top, sets)
    assert key(found) == key(gaps.held_values(top, long)) and found.count() == 3
    assert key(landscape.combos(sets, papers, 2)) == key(landscape.combos(long, papers, 2, once=True))
