import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import gaps, landscape, resolution


@pytest.fixture
def written(monkeypatch):
    """Rows of all that gaps writes, by label."""
    rows = {}
    real = gaps.Staged

    class Counted(real):
        def __init__(self, df, label):
            super().__init__(df, label)
            rows[label] = max(rows.get(label, 0), self.df.count())

    monkeypatch.setattr(gaps, "Staged", Counted)
    return rows


def _papers(spark):
    """Papers of four values a dimension, of which no one holds many combinations; some lack identifiers, some say a value thrice, some only what a guard rules out."""
    dims = ("problem", "population_or_setting", "method_family", "dataset", "constraint")
    rows = [(i, d, k, f"{d} topic {chr(97 + (i + k * (i % 3)) % 4)}", "as told") for i in range(60) for k, d in enumerate(dims)]
    rows += [(i, "constraint", 9 + n, "few-shot", "few-shot") for i in range(0, 60, 2) for n in range(3)]
    rows += [(i, "constraint", 20, "Latency", "measured" if i % 2 else "") for i in range(30)]
    rows += [(None, "problem", 0, "problem topic a", "as told"), (61, "method_family", 0, "method family topic A models", "as told"), (61, "method_family", 1, "method family topic a", "as told")]
    return spark.createDataFrame(rows, "paper_id int, dimension string, ord int, value string, evidence_text string")


def test_support_of_candidates_that_share_values_is_counted_without_a_row_for_each(spark, written):
    claims = _papers(spark)
    features = claims.where("paper_id is not null").select("paper_id", F.col("paper_id").alias("ord"), "dimension", "value").distinct()
    members = landscape.members(features)
    freq = landscape.frequencies(features, features.select("paper_id").distinct())
    idea = spark.createDataFrame([("problem", "problem topic a"), ("method", "method_family topic b"), ("constraint", "few-shot")], "dimension string, value string")
    found, basis, support = gaps.generate(features, 61, freq, members, claims, idea, F.array(*map(F.lit, ("problem", "topic", "few", "shot"))), limit=50)
    got = {r.candidate_id: r.n_support for r in found.collect()}
    want = {r.candidate_id: r.n for r in support.groupBy("candidate_id").agg(F.countDistinct("paper_id").alias("n")).collect()}
    assert len(got) == 50 and got == want and basis.select("candidate_id").distinct().count() == 50
    # Nothing is directly supported here, so no support is written.
    assert written["support"] == 0 and written["paper-sets"] <= 61


def test_counted_support_is_that_of_the_rows(spark):
    claims = _papers(spark)
    members = landscape.members(claims.select("paper_id", F.col("paper_id").alias("ord"), "dimension", "value"))
    named = claims.select("dimension", "value").distinct().collect()
    basis = [(f"c{i % 7}", r.dimension, r.value) for i, r in enumerate(sorted(named))] + [("all", r.dimension, r.value) for r in named] + [("none", "dataset", "nowhere"), ("none", "constraint", "none")]
    basis = spark.createDataFrame(basis, "candidate_id string, dimension string, value string")
    rows = gaps.collect_support(basis, claims, members, "contextual_support").groupBy("candidate_id").agg(F.countDistinct("paper_id").alias("n"))
    counted = {r.candidate_id: r.n_support for r in gaps.count_support(basis, claims, members).collect()}
    assert counted == {r.candidate_id: r.n for r in rows.collect()} and counted["all"] == 61 and "none" not in counted
    assert gaps.count_support(basis.where("false"), claims, members).count() == 0


def test_values_that_few_anchored_papers_hold_are_settled_in_all_papers(spark, monkeypatch):
    """b has two anchored papers, which are not both among the first looked at; c one that is full; d one that is not."""
    monkeypatch.setattr(gaps, "SOME", 1)
    members = spark.createDataFrame([("dataset", v, p) for v, ps in {"a": range(9), "b": (3, 8), "c": (5,), "d": (6,), "e": (7,)}.items() for p in ps], "dimension string, value string, paper_id int")
    anchors = spark.createDataFrame([(i, i == 5) for i in range(9) if i != 7], "paper_id int, full boolean")
    claims = spark.createDataFrame([(6, "limitation", 0, "nothing", "")], "paper_id int, dimension string, ord int, value string, evidence_text string")
    values = members.select("dimension", "value").distinct()
    strong = lambda claims: {r.value for r in gaps.strong_context(values, members, claims, anchors).where("strong").collect()}
    assert strong(claims) == {"a", "b", "c"}
    assert strong(claims.withColumn("evidence_text", F.lit("too little d"))) == {"a", "b", "c", "d"}


def test_a_block_whose_authors_share_a_word_is_decided_in_linear_time():
    """Records of one title with DOIs of their own, by five people of one first name: each record meets the few known works, not all that have the name."""
    names = ["abel", "bat", "cook", "dean", "east"]
    n = 20_000
    rows = [(i, i, "t|2000", [f"10.1/{i}"], [f"Ann {names[i * i % 11 % 5]}"]) for i in range(n)]
    block = resolution._Block(pd.DataFrame(rows, columns=["ord", "root", "title_year", "dois", "authors"]))
    began = time.process_time()
    for o in block.order:
        block.meet(o, "t|2000")
    took = time.process_time() - began
    assert {block.parent[o] for o in block.order} == {next(r[0] for r in rows if r[4] == [f"Ann {x}"]) for x in {names[i * i % 11 % 5] for i in range(n)}}
    # Quadratic work takes half a minute here.
    assert took < 10


def test_blocks_are_decided_as_by_meeting_every_known_cluster(monkeypatch):
    """The clusters that a record meets are the same whether they are found among the known ones or by words of names."""
    made = random.Random(4)
    people = ["abel", "bat", "bell", "cook", "east dove", "xavier young"]
    for _ in range(60):
        rows, first = [], {}
        for i in range(50):
            doi = [] if made.random() < 0.15 else [f"10.1/{made.randrange(40)}"]
            rows.append((i, first.setdefault(doi[0], i) if doi else i, f"t|{2000 + made.randrange(2)}", doi, [f"Ann {made.choice(people)}"]))
        df = pd.DataFrame(rows, columns=["ord", "root", "title_year", "dois", "authors"])
        near = {tuple(sorted(made.sample(range(50), 2))) for _ in range(5)}
        got = resolution.decide_block(df, near)
        with monkeypatch.context() as m:
            m.setattr(resolution._Block, "candidates", lambda self, mine, identity: list(range(len(self.known[identity]))))
            assert resolution.decide_block(df, near) == got
