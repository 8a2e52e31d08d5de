"""Offline evaluation: retrieval, matching, extraction, attribution, classification, ratings, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as t

LABELS = ("well_studied", "promising_gap", "uncertain")


def identifier(c: Column) -> Column:
    return t.casefold(t.collapse(c))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = precision + recall
    return {"precision": precision, "recall": recall, "f1": F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))}


def ranked_ids(retrieved: DataFrame) -> DataFrame:
    """retrieved: case_id, ord, id. case_id, id (normalised), rank from 1 of first occurrences."""
    rows = retrieved.select("case_id", "ord", identifier(F.col("id")).alias("id")).where(F.col("id") != "")
    first = rows.groupBy("case_id", "id").agg(F.min("ord").alias("ord"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("ord")))


def ir_metrics(retrieved: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """case_id, recall_10, recall_50, mrr, ndcg_10 for every case with a positive judgement.

    judged: case_id, id, grade; an id judged twice counts with its best grade; grades of 0 are not relevant. A case
    without hits (or without predictions) scores 0 on all.
    """
    gold = judged.select("case_id", identifier(F.col("id")).alias("id"), F.col("grade").cast("double").alias("grade"))
    gold = gold.groupBy("case_id", "id").agg(F.max("grade").alias("grade")).where("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = gold.withColumn("i", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "id")))
    ideal = ideal.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") <= k, gain / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg")
    )
    hits = ranked_ids(retrieved).join(gold, ["case_id", "id"]).groupBy("case_id").agg(
        F.sum(F.when(F.col("rank") <= 10, 1).otherwise(0)).alias("h10"),
        F.sum(F.when(F.col("rank") <= 50, 1).otherwise(0)).alias("h50"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(hits, "case_id", "left").select(
        "case_id",
        zero(F.col("h10") / F.col("n")).alias("recall_10"),
        zero(F.col("h50") / F.col("n")).alias("recall_50"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg_10"),
    )


def macro(metrics: DataFrame, cases: DataFrame, names: list[str]) -> DataFrame:
    """Means over all cases, failed ones as 0, with cases_total and cases_scored."""
    rows = cases.select("case_id").distinct().join(metrics, "case_id", "left")
    means = [F.avg(F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in names]
    return rows.agg(F.count(F.lit(1)).alias("cases_total"), F.count(names[0]).alias("cases_scored"), *means)


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    """case_id, a, b: normalised, a < b, distinct. Pairs with an empty or equal end are left out (see bad_pairs)."""
    x, y = identifier(F.col("left")), identifier(F.col("right"))
    rows = pairs.select("case_id", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return rows.where((F.col("a") != "") & (F.col("a") != F.col("b"))).distinct()


def bad_pairs(pairs: DataFrame) -> DataFrame:
    x, y = identifier(F.col("left")), identifier(F.col("right"))
    return pairs.where(x.isNull() | y.isNull() | (x == "") | (y == "") | (x == y))


def pair_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of counts summed over cases: tp, fp, fn, precision, recall, f1."""
    g = unordered_pairs(gold).withColumn("g", F.lit(1))
    p = unordered_pairs(predicted).withColumn("p", F.lit(1))
    rows = g.join(p, ["case_id", "a", "b"], "full").agg(
        F.coalesce(F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)), F.lit(0)).alias("fn"),
    )
    return rows.select("*", *[c.alias(n) for n, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def extraction_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """case_id, field, tp, fp, fn over normalised distinct values (case_id, field, value); fields empty on both sides have no row."""
    side = lambda df, g: df.select("case_id", "field", "value", F.lit(g).alias("gold"), F.lit(not g).alias("predicted"))
    return marked_counts(side(gold, True).unionByName(side(predicted, False)))


def marked_counts(rows: DataFrame) -> DataFrame:
    """extraction_counts of rows (case_id, field, value, gold, predicted) that say which sides they stand on. Rows that are dealt by case are not shuffled again."""
    normal = rows.select("case_id", "field", t.evidence_key(F.col("value")).alias("v"), "gold", "predicted").where("v != '' and (gold or predicted)")
    values = normal.groupBy("case_id", "field", "v").agg(F.max("gold").alias("g"), F.max("predicted").alias("p"))
    return values.groupBy("case_id", "field").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g")).alias("fp"), F.count_if(~F.col("p")).alias("fn"))


def extraction_metrics(counts: DataFrame) -> DataFrame:
    """field, tp, fp, fn, precision, recall, f1, exact_accuracy by field from summed counts, then `macro` and `micro`."""
    per = counts.groupBy("field").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg(F.when((F.col("fp") == 0) & (F.col("fn") == 0), 1.0).otherwise(0.0)).alias("exact_accuracy"),
    )
    scores = lambda df: df.select("field", "tp", "fp", "fn", *[c.alias(n) for n, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()], "exact_accuracy")
    per = scores(per)
    summed = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    mean = per.agg(*summed, *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "exact_accuracy")]).withColumn("field", F.lit("macro"))
    micro = scores(per.agg(*summed).withColumns({"field": F.lit("micro"), "exact_accuracy": F.lit(None).cast("double")}))
    return per.unionByName(mean.where("precision is not null")).unionByName(micro)


def attribution(claims: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """One row: claims, supported, rate. claims: evidence_text, source, title, abstract; judgements: evidence_text, ok.

    A human judgement of a span decides; else the span must stand, normalised, in its declared title or abstract.
    Other sources count as unsupported.
    """
    span = t.evidence_key(F.col("evidence_text"))
    place = F.when(F.col("source") == "title", F.col("title")).when(F.col("source") == "abstract", F.col("abstract"))
    found = F.coalesce((span != "") & F.contains(t.evidence_key(place), span), F.lit(False))
    rows = claims
    if judgements is not None:
        ok = judgements.groupBy("evidence_text").agg(F.max("ok").alias("ok"))
        rows, found = claims.join(ok, "evidence_text", "left"), F.coalesce(F.col("ok"), found)
    out = rows.select(found.alias("s")).agg(F.count(F.lit(1)).alias("total_claims"), F.count_if("s").alias("supported_claims"))
    return out.withColumn("supported_claim_rate", ratio(F.col("supported_claims"), F.col("total_claims")))


def confusion(cases: DataFrame) -> DataFrame:
    """expected, predicted, n for all pairs of labels, zeros included. cases: case_id, expected, predicted (null or invalid: unscored)."""
    spark = cases.sparkSession
    grid = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "expected string, predicted string")
    counted = cases.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counted, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def label_metrics(cases: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1; unscored cases count as missed, accuracy is over all cases."""
    spark = cases.sparkSession
    good = F.col("predicted").isin(*LABELS)
    own, hit = F.col("expected") == F.col("label"), good & (F.col("predicted") == F.col("label"))
    grid = spark.createDataFrame([(x,) for x in LABELS], "label string")
    rows = cases.withColumn("predicted", F.when(good, F.col("predicted"))).join(F.broadcast(grid)).groupBy("label").agg(
        F.count_if(own & F.coalesce(hit, F.lit(False))).alias("tp"),
        F.count_if(~own & F.coalesce(hit, F.lit(False))).alias("fp"),
        F.count_if(own & ~F.coalesce(hit, F.lit(False))).alias("fn"),
    )
    return rows.select("*", *[c.alias(n) for n, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def verification_summary(cases: DataFrame) -> DataFrame:
    """One row. cases: expected, predicted, known, searched, confirmed (arrays of ids)."""
    ids = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), identifier), lambda x: x != ""))
    rows = cases.select(
        "expected", F.when(F.col("predicted").isin(*LABELS), F.col("predicted")).alias("predicted"),
        ids("known").alias("k"), ids("searched").alias("s"), ids("confirmed").alias("c"),
    )
    well = F.col("expected") == "well_studied"
    out = rows.agg(
        F.count(F.lit(1)).alias("cases_total"),
        F.count("predicted").alias("cases_scored"),
        F.count_if(F.col("expected") == F.col("predicted")).alias("right"),
        F.count_if(F.size("k") > 0).alias("counterexample_cases"),
        F.sum(F.size("k")).alias("known_counterexamples"),
        F.sum(F.size(F.array_intersect("k", "s"))).alias("discovered"),
        F.sum(F.size(F.array_intersect("k", "c"))).alias("confirmed"),
        F.count_if(well & (F.col("predicted") == "promising_gap")).alias("false_promising"),
        F.count_if(well).alias("well"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(
        "cases_total", "cases_scored", rate("right", "cases_total").alias("accuracy"), "counterexample_cases", "known_counterexamples",
        rate("discovered", "known_counterexamples").alias("discovery_rate"), rate("confirmed", "known_counterexamples").alias("confirmation_rate"),
        F.col("false_promising").alias("false_promising_count"), rate("false_promising", "well").alias("false_promising_rate"),
    )


def rating_stats(ratings: DataFrame) -> DataFrame:
    """key, mean, median, count, standard_deviation (of the population). ratings: candidate_id, criterion, rating."""
    key = F.when(F.col("criterion") == "overall", F.col("candidate_id")).otherwise(F.concat_ws(":", "candidate_id", "criterion"))
    return ratings.groupBy(key.alias("key")).agg(
        F.avg("rating").alias("mean"), F.median("rating").alias("median"), F.count(F.lit(1)).alias("count"),
        F.stddev_pop("rating").alias("standard_deviation"),
    )


def latency_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, least and greatest seconds by group; nulls aside."""
    return runs.groupBy(*by).agg(
        F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.min("seconds").alias("least"),
        F.max("seconds").alias("greatest"), F.count("seconds").alias("n"),
    )


def counter_deltas(snapshots: DataFrame) -> DataFrame:
    """name, delta: what a counter gained between two snapshots (name, before, after), at least 0; missing ones are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return snapshots.select("name", F.greatest(F.lit(0), zero("after") - zero("before")).alias("delta"))
