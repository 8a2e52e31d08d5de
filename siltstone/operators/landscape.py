"""The literature landscape over long tables.

features: paper_id, ord (of the paper), dimension, value. papers: paper_id, ord, study_type. Every count is
exact; the order of papers is carried by `ord` rather than by the order of arrival.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import features as f
from siltstone.functions import text as t
from siltstone.operators import bitmaps
from siltstone.sources.staging import Staged

# Dimensions in order, those that combine, and fields whose absence is counted.
DIMENSIONS = (
    "problem", "population_or_setting", "method", "method_family", "dataset", "dataset_type", "baseline",
    "performance_metric", "efficiency_metric", "study_type", "outcome", "constraint", "limitation", "future_work",
)
COMBINED = ("problem", "population_or_setting", "method", "method_family", "dataset", "dataset_type", "baseline", "constraint")
MISSING = (
    ("research_objective", "problem"), ("population_or_setting", "population_or_setting"), ("methods", "method"),
    ("datasets", "dataset"), ("sample_size", "sample_size"), ("baselines", "baseline"),
    ("evaluation_metrics", "performance_metric"), ("outcomes", "outcome"), ("constraints", "constraint"),
    ("limitations", "limitation"), ("future_work", "future_work"),
)
EMPIRICAL = ("empirical", "methodological")
SOURCE_LEVELS = ("full_text", "abstract", "abstract_fallback", "metadata_only")
#: What comparable studies share, and papers of a key on either side of a cell of its grid.
KEYS = ("kp", "kf", "km")
CELL = 2_000
FULL_TEXT_STATUS = ("usable", "unavailable", "fetch_failed", "parse_failed", "not_attempted")


def features_from_claims(claims: DataFrame) -> DataFrame:
    """claims: paper_id, ord, field, item_ord, value. Their normalised features, first occurrence of each value.

    Fields map to dimensions; methods count as families, too, and efficiency metrics as both kinds.
    """
    field_dims = {
        "research_objective": ["problem"], "population_or_setting": ["population_or_setting"],
        "method_or_intervention": ["method", "method_family"], "datasets": ["dataset"],
        "comparison_or_baseline": ["baseline"], "evaluation_metrics": ["performance_metric", "efficiency_metric"],
        "main_findings": ["outcome"], "constraints": ["constraint"], "limitations": ["limitation"], "future_work": ["future_work"],
    }
    table = F.create_map(*[x for k, v in field_dims.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = claims.select("paper_id", "ord", "item_ord", "value", F.explode(F.element_at(table, F.col("field"))).alias("dimension"))
    rows = rows.where((F.col("dimension") != "efficiency_metric") | (f.metric_kind(F.col("value")) == "efficiency"))
    rows = rows.withColumn("value", f.normalised(F.col("dimension"), F.col("value"))).where(F.col("value") != "")
    return rows.groupBy("paper_id", "ord", "dimension", "value").agg(F.min("item_ord").alias("item_ord"))


def usable(features: DataFrame) -> DataFrame:
    return features.where(F.col("value").isNotNull() & ~F.trim(t.casefold(F.col("value"))).isin(*t.SENTINELS))


def total(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count(F.lit(1)).alias("total"))


def members(features: DataFrame, once: bool = False) -> DataFrame:
    """dimension, value, paper_id, ord: which papers hold a value, as a long table. A value may be held by a third of all papers, so
    no operator gathers them into one row. once: features have no row twice, so that they need not be shuffled to sort such out."""
    rows = usable(features).select("dimension", "value", "paper_id", "ord")
    return rows if once else rows.distinct()


def frequencies(features: DataFrame, papers: DataFrame, once: bool = False) -> DataFrame:
    """dimension, value, count, prevalence: distinct papers of each value; the denominator is all papers. See members for which, and for once."""
    counted = members(features, once).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))
    out = counted.join(F.broadcast(total(papers)))
    return out.select("dimension", "value", "count", (F.col("count") / F.col("total")).alias("prevalence"))


def frequency_order() -> list:
    return [F.desc("count"), F.asc("dimension"), F.asc("value")]


def joint_tuples(values: Column, size: int) -> Column:
    """All arrays of `size` entries d, one of each of `size` different dimensions, in dimension order. values: sorted array of (i, d)."""

    def longer(of: Column) -> Column:
        def after(p: Column) -> Column:
            later = F.filter(values, lambda y: y["i"] > p["last"])
            return F.transform(later, lambda y: F.struct(y["i"].alias("last"), F.concat(p["dims"], F.array(y["d"])).alias("dims")))

        return F.flatten(F.transform(of, lambda p: after(p)))

    out = F.transform(values, lambda x: F.struct(x["i"].alias("last"), F.array(x["d"]).alias("dims")))
    for _ in range(size - 1):
        out = longer(out)
    return F.transform(out, lambda p: p["dims"])


def combos(features: DataFrame, papers: DataFrame, size: int, once: bool = False) -> DataFrame:
    """dims (array of dimension=value in dimension order), count, prevalence: papers that hold all values together.

    Counted in arrays or on bitmaps of papers, so only combinations that occur are made, and none is a row for each paper;
    reviews and surveys take no part, but stay in the denominator. once: see members. features may also be a row a paper (staged): paper_id, study_type, feats (distinct dimension and value).
    """
    if not 2 <= size <= 5:
        raise ValueError("size must lie between 2 and 5")
    place = F.create_map(*[x for i, d in enumerate(COMBINED) for x in (F.lit(d), F.lit(i))])
    if "feats" in features.columns:
        # One row a paper, with its study type: nothing is joined, gathered or written again.
        fit = F.filter("feats", lambda x: x["dimension"].isin(*COMBINED) & x["value"].isNotNull() & ~F.trim(t.casefold(x["value"])).isin(*t.SENTINELS))
        held = F.transform(fit, lambda x: F.struct(F.element_at(place, x["dimension"]).cast("int").alias("i"), x["dimension"].alias("dimension"), x["value"].alias("value")))
        counted = bitmaps.together_held(features.where(F.col("study_type").isin(*EMPIRICAL)).select("paper_id", held.alias("held")), size)
        return counted.join(F.broadcast(total(papers))).select("dims", "count", (F.col("count") / F.col("total")).alias("prevalence"))
    kept = papers.where(F.col("study_type").isin(*EMPIRICAL)).select("paper_id")
    rows = usable(features).where(F.col("dimension").isin(*COMBINED)).join(kept, "paper_id", "left_semi")
    rows = rows.select("paper_id", "dimension", "value")
    counted = bitmaps.together(rows if once else rows.distinct(), F.element_at(place, F.col("dimension")), size)
    return counted.join(F.broadcast(total(papers))).select("dims", "count", (F.col("count") / F.col("total")).alias("prevalence"))


def all_combos(features: DataFrame, papers: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [combos(features, papers, n) for n in range(2, 6)])


N_SPECS = sum(len(list(combinations(COMBINED, n))) for n in range(2, 6))


def missing_fields(features: DataFrame, papers: DataFrame) -> DataFrame:
    """field, n_missing: papers without any value of the field (sentinels count as values)."""
    names = F.create_map(*[x for k, d in MISSING for x in (F.lit(d), F.lit(k))])
    have = features.where(F.col("value").isNotNull()).select("paper_id", F.element_at(names, F.col("dimension")).alias("field"))
    have = have.where(F.col("field").isNotNull()).distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    spark = features.sparkSession
    every = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(MISSING)], "ord int, field string")
    out = every.join(have, "field", "left").join(F.broadcast(total(papers)))
    return out.select("ord", "field", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n_missing"))


def source_coverage(coverage: DataFrame) -> DataFrame:
    """kind, name, n: papers by source level and by full-text status, and usable truncated documents; zeros included."""
    spark = coverage.sparkSession
    names = [("source_level", x) for x in SOURCE_LEVELS] + [("full_text_status", x) for x in FULL_TEXT_STATUS] + [("truncated", "usable")]
    every = spark.createDataFrame(names, "kind string, name string")
    pairs = F.array(
        F.struct(F.lit("source_level").alias("kind"), F.col("source_level").alias("name")),
        F.struct(F.lit("full_text_status").alias("kind"), F.col("full_text_status").alias("name")),
        F.struct(F.lit("truncated").alias("kind"), F.when(F.col("truncated") & (F.col("full_text_status") == "usable"), "usable").alias("name")),
    )
    counted = coverage.select(F.inline(pairs)).where(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, ["kind", "name"], "left").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))


def conflicts(wide: DataFrame, cell: int = CELL) -> DataFrame:
    """left_id, right_id, topic of comparable studies with opposed findings.

    wide: paper_id, ord, study_type and arrays problems, method_families, performance_metrics, datasets,
    populations, baselines, constraints, outcomes. Pairs meet on a shared (problem, family, metric), so studies that share
    none are never compared; on each key only papers with a finding meet those of the other polarity, `cell` by `cell` of them in a task.
    A paper has one row.
    """
    arrays = ("problems", "method_families", "performance_metrics", "datasets", "populations", "baselines", "constraints")
    rows = wide.where(F.col("study_type").isin(*EMPIRICAL)).select(
        "paper_id", "ord", *[t.usable(F.col(a)).alias(a) for a in arrays],
        F.array_distinct(F.filter(F.transform("outcomes", f.polarity), lambda p: p.isNotNull())).alias("signs"),
    ).where(F.size("signs") > 0)
    keyed = rows.withColumn("sign", F.explode("signs"))
    for a, k in zip(arrays[:3], KEYS):
        keyed = keyed.withColumn(k, F.explode(a))
    keyed = Staged(keyed, "keyed").df
    # Where no study has two values, agreeing is being equal (or both empty): such arrays are keys, so only studies that agree on them meet, and nothing is left to compare.
    most = keyed.agg(*[F.max(F.size(a)).alias(a) for a in arrays]).first()
    several = [a for a in arrays if (most[a] or 0) > 1]
    also = {f"k_{a}": a for a in arrays[3:] if a not in several}
    keyed = keyed.select("paper_id", "ord", "sign", *KEYS, F.size("signs").alias("n_signs"), *several, *[F.concat_ws("", F.transform(a, lambda x: F.concat(F.lit("="), x))).alias(k) for k, a in also.items()])
    keys = (*KEYS, *also)
    a, b = on_grid(keyed, cell, keys)
    a, b = a.alias("a"), b.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "_r", "_c")]

    def agrees(name: str):
        left, right = F.col(f"a.{name}"), F.col(f"b.{name}")
        return ((F.size(left) == 0) & (F.size(right) == 0)) | F.arrays_overlap(left, right)

    # Two studies that share several keys are a pair at the least of them alone, and two that both have findings of either kind in one order alone.
    least = [F.col(f"a.{k}") == F.array_min(F.array_intersect(F.col(f"a.{x}"), F.col(f"b.{x}"))) for x, k in zip(arrays[:3], KEYS) if x in several]
    first = F.col("a.ord") < F.col("b.ord")
    once = first | (F.col("a.n_signs") == 1) | (F.col("b.n_signs") == 1)
    met = a.join(b, [*same, F.col("a.paper_id") != F.col("b.paper_id"), *[agrees(x) for x in arrays[3:] if x in several], *least, once])
    pick = lambda c: F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    other = lambda c: F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    topic = F.array_intersect(pick("problems"), other("problems")).getItem(0) if "problems" in several else F.col("a.kp")
    return met.select(pick("paper_id").alias("left_id"), other("paper_id").alias("right_id"), topic.alias("topic"))


def on_grid(keyed: DataFrame, cell: int, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The rows of either sign with _r and _c: a key's papers of one sign are rows of a grid and those of the other its columns, `cell` papers to each at most about.

    A paper goes to all cells of its row or column, so two of them meet in one cell, and the pairs of a key, however many papers it has, are made in as many tasks as it has
    cells. Keys without papers of both signs have no cells.
    """
    up, down = F.count_if(F.col("sign") == 1), F.count_if(F.col("sign") == -1)
    sizes = keyed.groupBy(*keys).agg(F.ceil(up / cell).alias("_nr"), F.ceil(down / cell).alias("_nc")).where("_nr > 0 and _nc > 0")
    rows = keyed.join(sizes, list(keys))
    place = lambda n: F.pmod(F.xxhash64("paper_id"), F.col(n))
    line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = rows.where("sign = 1").select("*", place("_nr").alias("_r"), line("_nc").alias("_c"))
    b = rows.where("sign = -1").select("*", line("_nr").alias("_r"), place("_nc").alias("_c"))
    return a, b


def top_values(frequency: DataFrame, n: int = 10) -> DataFrame:
    """The n commonest values of each dimension, with rank."""
    w = Window.partitionBy("dimension").orderBy(F.desc("count"), "value")
    return frequency.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def report(frequency: DataFrame, combinations: DataFrame, n: int = 10) -> DataFrame:
    """section, rank, name, count: the n commonest values of each dimension, and the n commonest combinations that several papers hold and that one holds."""
    values = frequency.select(F.col("dimension").alias("section"), F.col("value").alias("name"), "count")
    name = F.array_join(F.transform("dims", lambda d: F.concat_ws("=", d["dimension"], d["value"])), " & ")
    kind = F.when(F.col("count") >= 2, "repeated combinations").otherwise("single combinations")
    rows = values.unionByName(combinations.select(kind.alias("section"), name.alias("name"), "count"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), "name"))
    return rows.withColumn("rank", place).where(F.col("rank") <= n)


def richest_evidence(evidence: DataFrame) -> DataFrame:
    """One row per canonical_id: most populated, then most confident, then first. evidence: canonical_id, n_values, confidence, ord."""
    w = Window.partitionBy(F.lower("canonical_id")).orderBy(F.desc("n_values"), F.desc("confidence"), "ord")
    return evidence.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def canonical_evidence(evidence: DataFrame, same_work: DataFrame) -> DataFrame:
    """evidence with canonical_id: the canonical work it maps to, if exactly one does. same_work: paper_id, canonical_id."""
    one = same_work.groupBy(F.lower("paper_id").alias("k")).agg(F.countDistinct("canonical_id").alias("n"), F.max("canonical_id").alias("canonical_id"))
    one = one.where("n = 1").drop("n")
    joined = evidence.join(one, F.lower(evidence["paper_id"]) == F.col("k"), "left")
    return joined.select(*evidence.columns, F.coalesce("canonical_id", evidence["paper_id"]).alias("canonical_id"))


def with_relevance(papers: DataFrame, scores: DataFrame) -> DataFrame:
    return papers.join(scores.select("paper_id", F.col("final_score").alias("relevance_score")), "paper_id", "left")
