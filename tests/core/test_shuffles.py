import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import gaps, landscape, verification
from siltstone.plans import views

SF = "/root/testdata/sf0.001"


def shuffled_by(df) -> list[str]:
    """The columns of each shuffle of the plan that is not by one value alone."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [", ".join(re.findall(r"([a-z_]+)#", x)) for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


@pytest.mark.parametrize("of", [views.features, views.line_features])
def test_features_are_shuffled_once_by_paper_and_counted_without_another_shuffle(spark, of):
    rows = of(spark, SF)
    freq = landscape.frequencies(rows, rows.select("paper_id").distinct(), once=True)
    assert not [x for x in shuffled_by(freq) if "paper_id" in x and x != "paper_id"]
    assert rows.count() == rows.distinct().count()
    assert sorted(map(str, freq.collect())) == sorted(map(str, landscape.frequencies(rows, rows.select("paper_id").distinct()).collect()))


def test_lines_and_orders_without_values_or_keys_stay(spark, tmp_path):
    for t in ("lineitem", "orders", "part", "supplier", "nation"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "part":
            df = df.withColumn("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).unionByName(df)
        if t == "lineitem":
            df = df.withColumn("l_orderkey", F.when(F.col("l_linenumber") != 2, F.col("l_orderkey")))
            df = df.unionByName(df.limit(50))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    rows = views.features(spark, str(tmp_path))
    line = views.load(spark, str(tmp_path), "lineitem").join(views.load(spark, str(tmp_path), "part"), F.expr("l_partkey = p_partkey"))
    want = line.select(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("value")).distinct()
    got = rows.where("dimension = 'method'").select("paper_id", "value")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_papers_that_state_a_basis_are_found_with_one_shuffle_by_paper(spark):
    claims = spark.createDataFrame(
        [(i, "problem", "research_objective", "urgent", "x") for i in range(4)] + [(i, "method_family", "method_or_intervention", "lora", "y") for i in (1, 3, 3)],
        "paper_id int, dimension string, field string, value string, evidence_text string",
    )
    basis = spark.createDataFrame([("c", "problem", "urgent"), ("c", "method_family", "lora")], "candidate_id string, dimension string, value string")
    found = verification.observed(basis, claims)
    assert [x for x in shuffled_by(found) if "paper_id" in x] == ["paper_id"]
    assert {tuple(r) for r in found.collect()} == {("c", 1), ("c", 3)}


def test_sides_of_papers(spark):
    rows = [(1, "method_family", "LoRA", "x"), (1, "method_family", "LoRA", "y"), (1, "baseline", "trees", "x"), (2, "method_family", "kernels", "x"), (2, "method_family", "waves", "x"),
            (2, "baseline", "unknown", "versus"), (3, "problem", "p", "versus"), (None, "baseline", "trees", "x")]
    claims = spark.createDataFrame(rows, "paper_id int, dimension string, value string, evidence_text string")
    of = gaps.sides(claims)
    assert {(r.paper_id, tuple(sorted(r.methods)), tuple(r.baselines), r.spoken) for r in of.collect()} == {(1, ("lora",), ("trees",), False), (2, ("kernels", "waves"), (), True)}
    assert {tuple(r) for r in gaps.observed_pairs(claims, of).collect()} == {("lora", "trees"), ("kernels", "waves")}
