"""Gap candidates over long tables.

frequency: dimension, value, count, prevalence; members: dimension, value, paper_id, ord (landscape). claims: paper_id, dimension, ord, value,
evidence_text, source, study_type. idea: dimension, value (its facets); idea_terms: one array of terms. A
candidate has a candidate_id, category, pattern_type, title, description, basis (dimension, value, count,
prevalence) and support (paper_id, evidence_type, value, role).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import features as f
from siltstone.functions import text as t
from siltstone.operators.landscape import COMBINED, joint_tuples
from siltstone.session import shipped
from siltstone.sources.staging import Staged

#: Values that may be broadcast, and papers of which most values are settled.
MANY, SOME = 50_000, 100_000
MIN_PAPERS, TOP_VALUES, MAX_CANDIDATES, PER_PAPER = 2, 4, 12, 2
#: Combined dimensions without the raw method, which the family stands for.
COMPARED = tuple(d for d in COMBINED if d != "method")
METHODS = ("method", "method_family", "baseline")
# Titles and descriptions of candidates, whose terms count towards their relevance; %s stand for values.
TEXTS = {
    "comparable_conflict": (
        "Conditions behind conflicting findings on %s",
        "Comparable retrieved studies report opposing findings. The conditions responsible for the disagreement remain a verification hypothesis.",
    ),
    "repeated_limitation": (
        "Repeated author-stated limitation: %s",
        "%s recurs across %d analyzed papers. This supports targeted follow-up but does not establish global absence.",
    ),
    "repeated_future_work": (
        "Repeated future-work direction: %s",
        "%s recurs across %d analyzed papers. This supports targeted follow-up but does not establish global absence.",
    ),
    "narrow_dataset_setting": (
        "Validation beyond %s data",
        "The analyzed evidence is concentrated in %s data. Evaluation in substantially different data or validation settings remains a candidate question requiring targeted verification.",
    ),
    "missing_comparison": (
        "Matched comparison of %s and %s",
        "Both method families are repeatedly represented in the analyzed evidence, but no explicit matched comparison between them was observed in the structured comparison evidence.",
    ),
}
# The same of combinations, by the dimensions of a pair in order, of other pairs, and of more than two values.
PAIR_TEXTS = {
    ("problem", "method_family"): ("{right} for {left}", "The analyzed evidence contains {left} and {right}, but their joint occurrence was not observed in the structured literature landscape."),
    ("method_family", "population_or_setting"): ("{left} in {right}", "The analyzed evidence contains {left} and {right} separately, but not their joint occurrence."),
    ("method_family", "dataset"): ("{left} evaluated with {right}", "The analyzed landscape contains {left} and {right} data separately, but their joint evaluation was not observed."),
    ("method_family", "dataset_type"): ("{left} evaluated with {right}", "The analyzed landscape contains {left} and {right} data separately, but their joint evaluation was not observed."),
    ("method_family", "constraint"): ("{left} under {right}", "The analyzed landscape contains {left} and {right} separately, but not their joint experimental occurrence."),
}
OTHER_PAIR = ("Combination of {left} and {right}", "The analyzed landscape contains {left} and {right} separately, but not their joint occurrence.")
MORE_VALUES = ("Combination of {all}", "The analyzed landscape contains each component, but this complete structured combination was not observed within one paper.")
CATEGORIES = {
    "comparable_conflict": "contradiction", "repeated_limitation": "limitation", "repeated_future_work": "future_work", "combination_gap": "combination",
    "narrow_dataset_setting": "dataset", "missing_comparison": "comparison",
}
NARROW_SHARE = 0.6
COMPARISON_WORDS = r"(?i)\b(?:compar(?:e|ed|es|ing|ison)|versus|vs\.?|against|outperform(?:s|ed|ing)?|relative to|baseline)\b"


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows it to have at most MANY rows."""
    return F.broadcast(df) if df.limit(MANY + 1).count() <= MANY else df


def _nothing(df: DataFrame) -> DataFrame:
    """df without rows; what is made of it reads nothing."""
    return df.where(F.lit(False))


def named_values(claims: DataFrame) -> DataFrame:
    """dimension, value, placed (whether a claim with a paper names it): the values of claims, written once, so that each is looked at once however many claims name it."""
    return Staged(claims.groupBy("dimension", "value").agg(F.max(F.col("paper_id").isNotNull()).alias("placed")), "named-values").df


def idea_anchor(rows: DataFrame, idea: DataFrame, idea_terms: Column) -> DataFrame:
    """rows (dimension, value, ...) with anchored: whether the idea names the value.

    Methods, problems, constraints and datasets compare normalised with the idea's facets (methods with its methods
    and comparisons alike); other dimensions need all their terms in the idea.
    """
    kind = lambda c: F.when(c.isin(*METHODS, "comparison"), "method_family").otherwise(c)
    facts = idea.select(kind(F.col("dimension")).alias("_d"), f.normalised(F.col("dimension"), F.col("value")).alias("_v")).where("_v != ''").distinct()
    keyed = rows.withColumns({"_k": kind(F.col("dimension")), "_n": f.normalised(F.col("dimension"), F.col("value"))})
    joined = keyed.join(facts, (F.col("_k") == F.col("_d")) & (F.col("_n") == F.col("_v")), "left")
    terms = f.gap_terms(F.col("value"))
    by_terms = (F.size(terms) > 0) & (F.size(F.array_except(terms, idea_terms)) == 0)
    exact = F.col("dimension").isin(*METHODS, "problem", "constraint", "dataset")
    return joined.withColumn("anchored", F.when(exact, F.col("_d").isNotNull()).otherwise(by_terms)).drop("_k", "_n", "_d", "_v")


def repeated(members: DataFrame, dimension: str, n_covered: int) -> DataFrame:
    """dimension, value, n_papers of limitations or future work that at least two papers state.

    Spellings with one key count together, under the commonest of them; at least two papers must report the field at all.
    """
    rows = members.where((F.col("dimension") == dimension) & f.concrete_entity(F.col("value"))).select(t.evidence_key(F.col("value")).alias("key"), "value", "paper_id")
    n = rows.groupBy("key").agg(F.countDistinct("paper_id").alias("n_papers")).where((F.col("n_papers") >= MIN_PAPERS) & F.lit(n_covered >= MIN_PAPERS))
    spelled = rows.groupBy("key", "value").agg(F.countDistinct("paper_id").alias("c")).groupBy("key").agg(F.min_by("value", F.struct((-F.col("c")).alias("c"), "value")).alias("value"))
    return n.join(spelled, "key").select(F.lit(dimension).alias("dimension"), "value", "n_papers")


def conflict_candidates(conflicts: DataFrame, n_papers: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, basis) of conflicts (left_id, right_id, topic) on concrete topics, one for each topic.

    Their basis has the dimension `conflict`, which verification does not accept.
    """
    rows = conflicts.where(f.concrete_entity(F.col("topic"))).select("topic", F.explode(F.array("left_id", "right_id")).alias("paper_id"))
    topics = rows.groupBy("topic").agg(F.countDistinct("paper_id").alias("count"))
    named = topics.withColumn("candidate_id", F.concat(F.lit("conflict-"), t.gap_key(F.col("topic"))))
    candidates = named.select(
        "candidate_id", F.lit("contradiction").alias("category"), F.lit("comparable_conflict").alias("pattern_type"),
        F.format_string(TEXTS["comparable_conflict"][0], "topic").alias("title"), F.lit(TEXTS["comparable_conflict"][1]).alias("description"),
    )
    basis = named.select("candidate_id", F.lit(0).alias("ord"), F.lit("conflict").alias("dimension"), F.col("topic").alias("value"), "count", (F.col("count") / max(1, n_papers)).alias("prevalence"))
    return candidates, basis


def top_values(anchored: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    """The n values of each combined dimension that count: named by the idea first, then by papers, then by name."""
    rows = anchored.where(F.col("dimension").isin(*COMPARED) & f.concrete_entity(F.col("value")))
    w = Window.partitionBy("dimension").orderBy(F.desc("anchored"), F.desc("count"), t.casefold(F.col("value")), "value")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _place(c: Column) -> Column:
    return F.element_at(F.create_map(*[x for i, d in enumerate(COMPARED) for x in (F.lit(d), F.lit(i))]), c)


def held_values(top: DataFrame, features: DataFrame) -> DataFrame:
    """v: the distinct sets of top values that papers hold, each an array of (i, (dimension, value)) in dimension order.

    features: rows of paper_id, dimension, value, or a row a paper with feats, an array of distinct (dimension, value), of which nothing is shuffled but the distinct sets.
    """
    entry = lambda d, x: F.struct(_place(d).alias("i"), x.alias("d"))
    if "feats" in features.columns:
        # top is bounded (see unobserved), so it goes to every task as one row: entries by dimension and value.
        own = top.select("dimension", "value").distinct().withColumn("e", entry(F.col("dimension"), F.struct("dimension", "value")))
        by_value = own.groupBy("dimension").agg(F.map_from_entries(F.collect_list(F.struct("value", "e"))).alias("of"))
        one = F.broadcast(by_value.agg(F.map_from_entries(F.collect_list(F.struct("dimension", "of"))).alias("_top")))
        mine = F.transform("feats", lambda x: F.try_element_at(F.try_element_at("_top", x["dimension"]), x["value"]))
        sets = features.select("feats").join(one).select(F.array_sort(F.filter(mine, lambda x: x.isNotNull())).alias("v"))
        return sets.where(F.size("v") > 0).distinct()
    kept = features.join(F.broadcast(top.select("dimension", "value")), ["dimension", "value"], "left_semi")
    return kept.groupBy("paper_id").agg(F.array_sort(F.collect_set(entry(F.col("dimension"), F.struct("dimension", "value")))).alias("v")).select("v").distinct()


def unobserved(top: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """dims (dimension=value in dimension order), n_anchored, count of combinations that no one paper holds and that bear on the idea.

    At least two of the dimensions must have a top value that the idea names, at least one value of the combination must be named, and each other
    one be strong where top says so (strong; without that column no value has to be). top holds at most TOP_VALUES values for each of seven dimensions, so
    there are at most 21,000 combinations of any size, made from that bounded table; held (see held_values) decides which of them occur.
    """
    strong = F.col("strong") if "strong" in top.columns else F.lit(True)
    named = F.max(F.col("anchored").cast("int")).over(Window.partitionBy("dimension"))
    weak = (~(F.col("anchored") | strong)).cast("int")
    vals = F.broadcast(top.select(_place(F.col("dimension")).alias("i"), F.struct("dimension", "value").alias("d"), F.col("anchored").cast("int").alias("a"), named.alias("x"), weak.alias("w"), "count"))
    out = vals.select("i", F.array("d").alias("dims"), F.col("a").alias("n_anchored"), F.col("x").alias("n_named"), F.col("w").alias("n_weak"), "count")
    for _ in range(size - 1):
        nxt = vals.select(F.col("i").alias("j"), "d", "a", "x", "w", F.col("count").alias("c"))
        out = out.join(nxt, F.col("j") > F.col("i")).select(
            F.col("j").alias("i"), F.concat("dims", F.array("d")).alias("dims"), (F.col("n_anchored") + F.col("a")).alias("n_anchored"),
            (F.col("n_named") + F.col("x")).alias("n_named"), (F.col("n_weak") + F.col("w")).alias("n_weak"), (F.col("count") + F.col("c")).alias("count"),
        )
    out = out.where((F.col("n_named") >= min(2, size)) & (F.col("n_anchored") > 0) & (F.col("n_weak") == 0)).select("dims", "n_anchored", "count")
    tuples = held.select(F.explode(joint_tuples(F.col("v"), size)).alias("dims")).distinct()
    return out.join(tuples, "dims", "left_anti")


def combination_candidates(anchored: DataFrame, features: DataFrame, limit: int = MAX_CANDIDATES * 8) -> DataFrame:
    """Unobserved combinations of five values down to two, in rank order: larger, more anchored, commoner, by name.

    anchored: dimension, value, count, anchored, and strong where relevance is asked for. The top values and the sets that papers hold are written once, as
    four sizes read them.
    """
    more = ["strong"] if "strong" in anchored.columns else []
    top = Staged(top_values(anchored).select("dimension", "value", "count", "anchored", *more), "top-values").df
    held = Staged(held_values(top, features), "held-values").df
    rows = reduce(DataFrame.unionByName, [unobserved(top, held, n) for n in range(5, 1, -1)])
    names = F.transform("dims", lambda d: F.concat_ws("=", d["dimension"], t.casefold(d["value"])))
    order = [F.size("dims").desc(), F.desc("n_anchored"), F.desc("count"), names]
    # The combinations are few (see unobserved), so one task may rank them.
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).where(F.col("rank") <= limit)


def sides(claims: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """paper_id, methods, baselines (the families that its claims on either name, as arrays), spoken: whether a claim on baselines speaks of comparing.

    A value is looked at once, however many claims name it, and claims are shuffled once. only: fam; of other families none is named, and papers without one of these are left out.
    """
    rows = claims.where(F.col("dimension").isin("method_family", "baseline") & F.col("paper_id").isNotNull())
    spoken = (F.col("dimension") == "baseline") & F.concat_ws(" ", "value", "evidence_text").rlike(COMPARISON_WORDS)
    rows = rows.select("paper_id", "dimension", "value", spoken.alias("spoken"))
    values = Staged(rows.select("value").distinct(), "values").df.where(f.concrete_entity(F.col("value"))).select("value", f.method(F.col("value")).alias("v")).where("v != ''")
    values = Staged(values if only is None else values.join(_few(only), F.col("v") == F.col("fam"), "left_semi"), "families").df
    named = rows.join(_few(values), "value", "left")
    if only is not None:
        named = named.where("v is not null or spoken")
    of = lambda d: F.collect_set(F.when(F.col("dimension") == d, F.col("v")))
    out = named.groupBy("paper_id").agg(of("method_family").alias("methods"), of("baseline").alias("baselines"), F.max("spoken").alias("spoken"))
    return out if only is None else out.where(F.size("methods") > 0)


def _paired(of: DataFrame, x: str, y: str) -> DataFrame:
    """a, b (a < b): the pairs of one value of x and one of y (arrays of a row)."""
    pair = of.select(y, F.explode(x).alias("x")).select("x", F.explode(y).alias("y")).where("x != y")
    return pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def observed_pairs(claims: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """a, b (a < b): families compared in a paper: its methods with its baselines, and its methods among each other where it speaks of comparing.

    of: the sides of the claims, where they are at hand.
    """
    of = sides(claims) if of is None else of
    return _paired(of, "methods", "baselines").unionByName(_paired(of.where("spoken").withColumn("others", F.col("methods")), "methods", "others")).distinct()


def justified_pairs(claims: DataFrame, idea: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """a, b (a < b): families that there is a positive reason to compare.

    Either one comparison that the idea asks for holds the terms of both; or a paper has one among its methods and the other among its baselines; or one
    of its claims on baselines speaks of comparing and holds the terms of both. Pairs come from single claims and papers, never from all families.
    of: see observed_pairs.
    """
    of = sides(claims) if of is None else of
    cross = _paired(of, "methods", "baselines")
    return cross.unionByName(spoken_pairs(claims, idea, of.select(F.explode("methods").alias("fam")).distinct())).distinct()


def spoken_pairs(claims: DataFrame, idea: DataFrame, families: DataFrame) -> DataFrame:
    """a, b (a < b): of justified_pairs those that one comparison of the idea, or one claim that speaks of comparing, holds the terms of. families: fam, distinct.

    The others are compared in a paper, so none of them is missing.
    """
    asked = idea.where(F.col("dimension").isin("comparison", "baseline")).select(F.col("value").alias("text"))
    # Written once: else the pattern would move below the distinct, and be looked for in every claim.
    said = Staged(claims.where(F.col("dimension") == "baseline").select(F.concat_ws(" ", "value", "evidence_text").alias("text")).distinct(), "said").df
    texts = asked.unionByName(said.where(F.col("text").rlike(COMPARISON_WORDS))).distinct().select("text", f.gap_terms(F.col("text")).alias("have"))
    fam = families.withColumn("need", f.gap_terms(F.col("fam"))).where(F.size("need") > 0)
    named = texts.select("text", "have", F.explode("have").alias("_t")).join(fam.withColumn("_t", F.col("need")[0]), "_t")
    named = Staged(named.where(F.size(F.array_except("need", "have")) == 0).select("text", "fam").distinct(), "named").df
    both = named.select("text", F.col("fam").alias("x")).join(named.select("text", F.col("fam").alias("y")), "text").where("x != y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def missing_comparisons(frequency: DataFrame, observed: DataFrame, justified: DataFrame) -> DataFrame:
    """left, right, left_count, right_count: families of at least two papers each, for whose comparison there is a reason (justified: a, b), that no paper compares."""
    fam = frequency.where((F.col("dimension") == "method_family") & (F.col("count") >= MIN_PAPERS) & f.concrete_entity(F.col("value")))
    fam = fam.select(f.method(F.col("value")).alias("k"), "value", "count").where("k != ''")
    a, b = fam.select(F.col("k").alias("a"), F.col("count").alias("left_count")), fam.select(F.col("k").alias("b"), F.col("count").alias("right_count"))
    pairs = justified.select("a", "b").distinct().join(a, "a").join(b, "b")
    return pairs.join(observed, ["a", "b"], "left_anti").select(F.col("a").alias("left"), F.col("b").alias("right"), "left_count", "right_count")


def narrow_setting(frequency: DataFrame, total: int, share: float = NARROW_SHARE) -> DataFrame:
    """The dataset type of two papers at least, if it is the only such and stands in at least `share` of the `total` papers with datasets.

    (Dataset types are never inferred, so features made by this engine have none.)
    """
    rows = frequency.where((F.col("dimension") == "dataset_type") & (F.col("count") >= MIN_PAPERS) & f.concrete_entity(F.col("value")))
    # Two rows are enough to know that it is not the only one.
    alone = rows.limit(2).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where("_n = 1").drop("_n")
    return alone.where(F.col("count") >= share * max(1, total))


def record_anchors(claims: DataFrame, idea: DataFrame, idea_terms: Column, titles: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """paper_id, full: papers whose records the idea anchors; full where both a problem and a method of it do.

    Each of problems, methods and context (population, domain) that the idea has is a signal: a problem or a method family equal when normalised, or
    a term of the context in claims on problem and setting. One of them is enough. Without any, a paper is anchored if its claims, or its title (paper_id,
    title), share a term with the idea. names: see named_values, where they are at hand.
    """
    text = F.concat_ws(" ", "value", "evidence_text")
    kind = F.col("dimension")
    of = lambda *d: idea.where(kind.isin(*d))
    problems = of("problem").where(f.concrete_entity(F.col("value"))).select(f.problem(F.col("value")).alias("x")).where("x != ''").distinct()
    methods = of("method", "method_family").where(f.concrete_entity(F.col("value"))).select(f.method(F.col("value")).alias("x")).where("x != ''").distinct()
    context = of("problem", "population", "population_or_setting", "domain").select(F.explode(f.gap_terms(F.col("value"))).alias("x")).distinct()
    asked, signals = [], []
    names = named_values(claims) if names is None else names
    if not problems.isEmpty():
        asked.append(names.where(kind == "problem").withColumn("x", f.problem(F.col("value"))).join(problems, "x", "left_semi").select("dimension", "value", F.lit("p").alias("s")))
    if not methods.isEmpty():
        asked.append(names.where(kind.isin("method", "method_family")).withColumn("x", f.method(F.col("value"))).join(methods, "x", "left_semi").select("dimension", "value", F.lit("m").alias("s")))
    if asked:
        met = Staged(reduce(DataFrame.unionByName, asked), "anchoring").df
        signals.append(claims.join(_few(met), ["dimension", "value"]).select("paper_id", "s"))
    if not of("population", "population_or_setting", "domain").isEmpty():
        near = claims.where(kind.isin("problem", "population_or_setting")).select("paper_id", F.explode(f.gap_terms(text)).alias("x"))
        signals.append(near.join(context, "x", "left_semi").select("paper_id", F.lit("c").alias("s")))
    if not signals:
        bodies = claims.select("paper_id", text.alias("b"))
        if titles is not None:
            bodies = bodies.unionByName(titles.select("paper_id", F.col("title").alias("b")))
        return bodies.where(F.arrays_overlap(f.gap_terms(F.col("b")), idea_terms)).select("paper_id", F.lit(False).alias("full")).distinct()
    met = reduce(DataFrame.unionByName, signals).groupBy("paper_id")
    return met.agg((F.count_if(F.col("s") == "p") * F.count_if(F.col("s") == "m") > 0).alias("full"))


def strong_context(values: DataFrame, members: DataFrame, claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """values (dimension, value, ...) with strong: whether papers that the idea anchors connect them with it.

    Two such papers do; else one that states both a problem and a method of the idea, or whose limitations or future work share a term with the value.
    """
    own = values.select("dimension", "value").distinct()
    of = members.select("dimension", "value", "paper_id")
    # Two papers settle a value, and among some of the papers most values have two. Those are found without a shuffle of members; what is left is looked at in all papers.
    some = Staged(anchors.select("paper_id").limit(SOME), "some-anchors").df
    twice = of.join(F.broadcast(some), "paper_id", "left_semi").distinct().groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAPERS)
    strong = Staged(own.join(twice, ["dimension", "value"], "left_semi"), "settled").df
    left = Staged(own.join(strong, ["dimension", "value"], "left_anti"), "unsettled").df
    if not left.isEmpty():
        few = _few(left)
        held = of.join(few, ["dimension", "value"], "left_semi").distinct().join(anchors, "paper_id")
        open_ = claims.where(F.col("dimension").isin("limitation", "future_work")).select("paper_id", F.explode(f.gap_terms(F.concat_ws(" ", "value", "evidence_text"))).alias("w")).distinct()
        words = _few(Staged(left.select("dimension", "value", F.explode(f.gap_terms(F.col("value"))).alias("w")), "words").df)
        said = held.select("dimension", "value", "paper_id").join(words, ["dimension", "value"]).join(open_, ["paper_id", "w"], "left_semi")
        flags = held.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("full"))
        more = flags.where((F.col("n") >= MIN_PAPERS) | F.col("full")).select("dimension", "value").unionByName(said.select("dimension", "value")).distinct()
        strong = strong.unionByName(more)
    return values.join(strong.withColumn("_s", F.lit(True)), ["dimension", "value"], "left").withColumn("strong", F.coalesce("_s", F.lit(False))).drop("_s")


def relevant(basis: DataFrame) -> DataFrame:
    """candidate_id of candidates that bear on the idea, by their basis (candidate_id, anchored, strong).

    With a value that the idea names, all others must be strong; without one, a single value must be.
    """
    named, weak = F.count_if("anchored"), F.count_if(~(F.col("anchored") | F.col("strong")))
    n = basis.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), named.alias("k"), weak.alias("w"))
    return n.where("w = 0 and (k > 0 or n = 1)").select("candidate_id")


def _candidate(pattern: str, key: Column, title: Column, description: Column) -> list[Column]:
    ident = F.concat(F.lit(f"{pattern}-"), t.gap_key(key))
    return [ident.alias("candidate_id"), F.lit(CATEGORIES[pattern]).alias("category"), F.lit(pattern).alias("pattern_type"), title.alias("title"), description.alias("description")]


def _basis(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows (candidate_id, ord, dimension, value) with count, prevalence, anchored, strong of the values."""
    return rows.join(values.select("dimension", "value", "count", "prevalence", "anchored", "strong"), ["dimension", "value"]).select("candidate_id", "ord", "dimension", "value", "count", "prevalence", "anchored", "strong")


def reported(members: DataFrame, values: DataFrame, dimension: str) -> bool:
    """Whether two papers at least report a dimension: a value of that many papers shows it, else values are of one paper each, and so are few members."""
    most = values.where(F.col("dimension") == dimension).agg(F.max("count")).first()[0]
    if most is None or most >= MIN_PAPERS:
        return most is not None
    return members.where(F.col("dimension") == dimension).select("paper_id").distinct().limit(MIN_PAPERS).count() >= MIN_PAPERS


def repeated_builder(members: DataFrame, values: DataFrame, dimension: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, basis) of limitations or future work that papers repeat; the basis has every spelling."""
    pattern = f"repeated_{dimension}"
    rows = repeated(members, dimension, MIN_PAPERS) if reported(members, values, dimension) else repeated(_nothing(members), dimension, 0)
    title, description = TEXTS[pattern]
    named = rows.select(*_candidate(pattern, F.col("value"), F.format_string(title, "value"), F.format_string(description, "value", "n_papers")), t.evidence_key(F.col("value")).alias("_k"))
    spelled = values.where(F.col("dimension") == dimension).select("dimension", "value", t.evidence_key(F.col("value")).alias("_k"))
    basis = named.select("candidate_id", "_k").join(spelled, "_k").select("candidate_id", F.xxhash64("value").alias("ord"), "dimension", "value")
    return named.drop("_k"), _basis(basis, values)


def combination_builder(features: DataFrame, values: DataFrame, limit: int = MAX_CANDIDATES * 8) -> tuple[DataFrame, DataFrame]:
    """(candidates, basis) of unobserved combinations, written once."""
    rows = Staged(combination_candidates(values, features, limit), "combinations").df
    key = F.array_join(F.transform("dims", lambda d: F.concat_ws("=", d["dimension"], d["value"])), "&")
    named = rows.select(*_candidate("combination_gap", key, combination_text(0), combination_text(1)), "dims")
    basis = named.select("candidate_id", F.posexplode("dims").alias("ord", "d")).select("candidate_id", F.col("ord").cast("long").alias("ord"), "d.dimension", "d.value")
    return named.drop("dims"), _basis(basis, values)


def narrow_builder(members: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, basis) of the one dataset type that dominates, where two papers at least report datasets."""
    # Papers with datasets are counted only where there is a type that they may stand in.
    some = not narrow_setting(values, 0).isEmpty()
    total = members.where("dimension = 'dataset'").select("paper_id").distinct().count() if some else 0
    rows = narrow_setting(values, total).where(F.lit(total >= MIN_PAPERS))
    title, description = TEXTS["narrow_dataset_setting"]
    named = rows.select(*_candidate("narrow_dataset_setting", F.col("value"), F.format_string(title, "value"), F.format_string(description, "value")), "dimension", "value")
    basis = named.select("candidate_id", F.lit(0).cast("long").alias("ord"), "dimension", "value")
    return named.drop("dimension", "value"), _basis(basis, values)


def comparison_builder(
    claims: DataFrame, members: DataFrame, values: DataFrame, idea: DataFrame, anchors_context: DataFrame | None = None, names: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(candidates, basis) of missing comparisons, where two papers at least report baselines.

    anchors_context: paper_id of papers whose problem or setting shares a term with the idea's; where given, each family needs one that holds it.
    names: see named_values, where they are at hand. Papers are asked only whether they compare the families that there is a reason to compare, and nothing is asked
    where there are none.
    """
    names = named_values(claims) if names is None else names
    families = names.where((F.col("dimension") == "method_family") & F.col("placed") & f.concrete_entity(F.col("value"))).select(f.method(F.col("value")).alias("fam")).where("fam != ''").distinct()
    wanted = Staged(spoken_pairs(claims, idea, families), "wanted-pairs").df
    if wanted.isEmpty() or not reported(members, values, "baseline"):
        wanted, claims, members = _nothing(wanted), _nothing(claims), _nothing(members)
    of = Staged(sides(claims, wanted.select(F.explode(F.array("a", "b")).alias("fam")).distinct()), "sides").df
    pairs = missing_comparisons(values, observed_pairs(claims, of), wanted)
    spelled = values.where("dimension = 'method_family'").select(f.method(F.col("value")).alias("k"), "value")
    if anchors_context is not None:
        asked = pairs.select(F.explode(F.array("left", "right")).alias("k")).distinct()
        spelled = Staged(spelled.join(asked, "k", "left_semi"), "spelled").df
        near = members.where("dimension = 'method_family'").join(_few(spelled.select("value")), "value", "left_semi").join(anchors_context, "paper_id", "left_semi").select("value").distinct()
        spelled = spelled.join(near, "value", "left_semi")
    # Of several spellings of a family the first by name stands for it.
    spelled = spelled.groupBy("k").agg(F.min("value").alias("value"))
    both = pairs.join(spelled.toDF("left", "lv"), "left").join(spelled.toDF("right", "rv"), "right").select(F.least("lv", "rv").alias("lv"), F.greatest("lv", "rv").alias("rv"))
    title, description = TEXTS["missing_comparison"]
    named = both.select(*_candidate("missing_comparison", F.concat_ws("|", "lv", "rv"), F.format_string(title, "lv", "rv"), F.lit(description)), "lv", "rv")
    basis = named.select("candidate_id", F.posexplode(F.array("lv", "rv")).alias("ord", "value"))
    basis = basis.select("candidate_id", F.col("ord").cast("long").alias("ord"), F.lit("method_family").alias("dimension"), "value")
    return named.drop("lv", "rv"), _basis(basis, values)


def _worded(wants: DataFrame, names: DataFrame) -> DataFrame:
    """dimension, value, want, sure: the values of claims that are a wanted one (dimension, want) when normalised; sure where no evidence can speak against that."""
    norm = lambda c: f.normalised(F.col("dimension"), F.col(c))
    left = wants.where(_exact()).withColumn("_n", norm("want")).where("_n != ''")
    same = names.where(_exact() & f.concrete_entity(F.col("value"))).withColumn("_n", norm("value")).join(left, ["dimension", "_n"])
    return Staged(same.select("dimension", "value", "want", f.unguarded(F.col("want"), F.col("dimension")).alias("sure")), "worded").df


def _exact() -> Column:
    return F.col("dimension").isin(*METHODS, "comparison", "problem", "constraint", "dataset")


def _bearing(wants: DataFrame, worded: DataFrame, claims: DataFrame, members: DataFrame) -> DataFrame:
    """dimension, want, paper_id, ord, value, evidence_text: claims that bear a wanted value (dimension, want), at most twice a paper. worded: see _worded."""
    claims = claims.select("paper_id", "dimension", "ord", "value", "evidence_text")
    met = claims.join(_few(worded), ["dimension", "value"])
    others = Staged(wants.where(~_exact()), "wants").df
    if not others.isEmpty():
        held = members.select("dimension", F.col("value").alias("want"), "paper_id").join(_few(others), ["dimension", "want"])
        shared = F.arrays_overlap(f.gap_terms(F.col("want")), f.gap_terms(F.concat_ws(" ", "value", "evidence_text")))
        near = held.join(claims.join(F.broadcast(others.select("dimension").distinct()), "dimension", "left_semi").where(f.concrete_entity(F.col("value"))), ["dimension", "paper_id"]).where(shared)
        met = met.unionByName(near.withColumn("sure", F.lit(False)))
    w = Window.partitionBy("dimension", "want", "paper_id").orderBy("ord")
    met = met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= PER_PAPER).drop("_n")
    guarded = f.semantic_guard(F.col("want"), F.col("dimension"), F.col("value"), F.col("evidence_text"))
    return met.where(F.when(F.col("sure"), True).otherwise(guarded)).drop("sure")


def collect_support(basis: DataFrame, claims: DataFrame, members: DataFrame, role: str, names: DataFrame | None = None) -> DataFrame:
    """candidate_id, paper_id, evidence_type, value, evidence_text, role: claims that bear a candidate's basis (candidate_id, dimension, value).

    Values match normalised in their dimension; in others (limitations, future work) a claim of a paper that holds the value must share a term
    with it. Claims pass the semantic guards, and count at most twice a paper and once a key. names: see named_values, where they are at hand.
    """
    asked = basis.select("candidate_id", "dimension", F.col("value").alias("want")).distinct()
    if asked.isEmpty():
        claims, members, names = _nothing(claims), _nothing(members), None
    # Candidates share values, so claims are found and judged once a value.
    wants = asked.select("dimension", "want").distinct()
    met = _bearing(wants, _worded(wants, named_values(claims) if names is None else names), claims, members)
    met = met.join(_few(asked), ["dimension", "want"])
    rows = met.select("candidate_id", "paper_id", F.col("dimension").alias("evidence_type"), "value", "evidence_text", "ord", F.lit(role).alias("role"))
    return unique_evidence(rows)


def count_support(basis: DataFrame, claims: DataFrame, members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """candidate_id, n_support: the papers of collect_support of each candidate that has any, counted without a row for each candidate and paper.

    Papers are counted once for each set of values that their claims bear; a candidate has the papers of all sets that hold a value of its basis. Claims are put in order and
    guarded only for values that the guards look at.
    """
    asked = Staged(basis.select("candidate_id", "dimension", F.col("value").alias("want")).distinct(), "asked").df
    if asked.isEmpty():
        claims, members, names = _nothing(claims), _nothing(members), None
    wants = Staged(asked.select("dimension", "want").distinct().withColumn("w", F.monotonically_increasing_id()), "wants").df
    worded = _worded(wants.drop("w"), named_values(claims) if names is None else names)
    numbered = lambda df: df.join(_few(wants), ["dimension", "want"])
    met = claims.join(_few(Staged(numbered(worded.where("sure")).select("dimension", "value", "w"), "sure").df), ["dimension", "value"]).select("paper_id", "w")
    rest = Staged(wants.drop("w").join(worded.where("sure"), ["dimension", "want"], "left_anti"), "unsure").df
    if not rest.isEmpty():
        met = met.unionByName(numbered(_bearing(rest, worded.where("not sure"), claims, members)).select("paper_id", "w"))
    sets = met.where("paper_id is not null").groupBy("paper_id").agg(F.array_sort(F.collect_set("w")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    sets = Staged(sets.withColumn("id", F.monotonically_increasing_id()), "paper-sets").df
    of = _few(Staged(numbered(asked).select("candidate_id", "w"), "asked-numbers").df)
    hits = sets.select("id", "n", F.explode("s").alias("w")).join(of, "w").select("candidate_id", "id", "n").distinct()
    return hits.groupBy("candidate_id").agg(F.sum("n").alias("n_support"))


def unique_evidence(support: DataFrame) -> DataFrame:
    w = Window.partitionBy("candidate_id", "paper_id", "evidence_type", t.evidence_key(F.col("value")), "role").orderBy("ord")
    return support.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_basis(basis: DataFrame) -> DataFrame:
    w = Window.partitionBy("candidate_id", "dimension", t.evidence_key(F.col("value"))).orderBy("ord")
    return basis.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gate(candidates: DataFrame, support: DataFrame) -> DataFrame:
    """candidates that at least two papers support, with n_support. support: see collect_support, or counted: candidate_id, n_support."""
    n = support if "n_support" in support.columns else support.groupBy("candidate_id").agg(F.countDistinct("paper_id").alias("n_support"))
    return candidates.join(n.where(F.col("n_support") >= MIN_PAPERS), "candidate_id")


def relevance(candidates: DataFrame, basis: DataFrame, idea_terms: Column) -> DataFrame:
    """candidates with idea_relevance (share of their terms in the idea) and idea_anchor_score (share of their basis that the idea names)."""
    terms = f.gap_terms(F.concat_ws(" ", "title", "description"))
    share = F.size(F.array_intersect(terms, idea_terms)) / F.greatest(F.lit(1), F.size(terms))
    score = basis.groupBy("candidate_id").agg(F.avg(F.col("anchored").cast("double")).alias("idea_anchor_score"))
    out = candidates.withColumn("idea_relevance", F.least(F.lit(1.0), share)).join(score, "candidate_id", "left")
    return out.withColumn("idea_anchor_score", F.coalesce("idea_anchor_score", F.lit(0.0)))


CANDIDATE_ROW = "candidate_id string, root string"


def consolidate(candidates: DataFrame) -> DataFrame:
    """candidate_id, root: candidates of one category and pattern that are one.

    With a basis: equal key sets, by a grouped key. Without: terms overlapping by 0.6, or two shared papers, in order of title; that is
    decided greedily within (category, pattern) among candidates without basis, of which a run makes few. candidates:
    candidate_id, category, pattern_type, title, description, keys (of the basis), paper_ids (of candidates without basis; of others n_support is enough),
    n_direct. The root is the strongest.
    """
    papers = F.col("n_support") if "n_support" in candidates.columns else F.size("paper_ids")
    strength = F.struct(papers.alias("a"), F.col("n_direct").alias("b"), F.size(f.gap_terms(F.col("title"))).alias("c"), F.col("candidate_id").alias("d"))
    based = candidates.where(F.size("keys") > 0).withColumn("_k", F.array_sort(F.array_distinct("keys")))
    w = Window.partitionBy("category", "pattern_type", "_k")
    by_keys = based.select("candidate_id", F.max(strength).over(w)["d"].alias("root"))
    terms = f.gap_terms(F.concat_ws(" ", "title", "description"))
    bare = candidates.where(F.size("keys") == 0).select("candidate_id", "category", "pattern_type", "title", terms.alias("terms"), "paper_ids", "n_direct", F.size(f.gap_terms(F.col("title"))).alias("n_title"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        root: dict[str, str] = {}
        by_word: dict[str, set[int]] = {}
        by_paper: dict[str, set[int]] = {}
        for r in rows.sort_values(["title", "candidate_id"], key=lambda c: c.str.casefold()).to_dict("records"):
            words, papers = set(r["terms"]), set(r["paper_ids"])
            # Only those that share a word or a paper can be the same.
            shared = Counter(k for w in words for k in by_word.get(w, ()))
            same = {k for k, n in shared.items() if n / min(len(words), len(kept[k]["words"])) >= 0.6}
            same |= {k for k, n in Counter(k for p in papers for k in by_paper.get(p, ())).items() if n >= 2}
            mine = (len(papers), r["n_direct"], r["n_title"])
            at = min(same, default=len(kept))
            if at == len(kept):
                kept.append({"id": r["candidate_id"], "ids": [], "words": words, "papers": set(), "rank": mine})
            hit = kept[at]
            hit["ids"].append(r["candidate_id"])
            if mine > hit["rank"]:
                for w in hit["words"]:
                    by_word[w].discard(at)
                hit.update(id=r["candidate_id"], words=words, rank=mine)
            for w in hit["words"]:
                by_word.setdefault(w, set()).add(at)
            for paper in papers - hit["papers"]:
                by_paper.setdefault(paper, set()).add(at)
            hit["papers"] |= papers
        for k in kept:
            root.update(dict.fromkeys(k["ids"], k["id"]))
        return pd.DataFrame({"candidate_id": list(root), "root": list(root.values())})

    greedy = shipped(bare).groupBy("category", "pattern_type").applyInPandas(run, CANDIDATE_ROW)
    return by_keys.unionByName(greedy)


def priority() -> list[Column]:
    """Nine keys: anchored, specific to the idea, concrete, specific, larger, more matches, more support, pattern, id."""
    return [
        F.desc("idea_anchor_score"), F.desc("idea_specificity"), F.asc("n_generic"), F.desc("specificity"), F.size("keys").desc(), F.desc("n_anchored"),
        F.desc("n_support"), F.asc("pattern_type"), F.asc("candidate_id"),
    ]


def prioritise(candidates: DataFrame, basis: DataFrame) -> DataFrame:
    """candidates with keys, idea_specificity, specificity, n_generic, n_anchored of their basis."""
    rare = 1 - F.col("prevalence")
    scores = basis.groupBy("candidate_id").agg(
        F.collect_set(F.concat_ws("=", "dimension", t.evidence_key(F.col("value")))).alias("keys"), F.sum(F.when(F.col("anchored"), rare).otherwise(0.0)).alias("idea_specificity"),
        F.avg(rare).alias("specificity"), F.count_if(~f.concrete_entity(F.col("value"))).alias("n_generic"), F.count_if("anchored").alias("n_anchored"),
    )
    out = candidates.join(scores, "candidate_id", "left")
    return out.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))).na.fill(0, ["idea_specificity", "specificity", "n_generic", "n_anchored"])


def _dominance(ranked: DataFrame, threshold: float) -> DataFrame:
    """later, earlier: candidates of one group of which the earlier, if it is kept, makes the later go.

    ranked: c, grp, place, keys, m. Both ways to go ask for common keys: of a set that contains the later's keys its rarest, and of a set that overlaps them by
    the threshold one of its first few by rarity. So a candidate meets others by equality of those keys alone, and rare ones.
    """
    held = ranked.select("c", "grp", F.explode("keys").alias("key"))
    rarity = held.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("df"))
    ordered = held.join(rarity, ["grp", "key"]).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("s"))
    few = F.size("s") - F.ceil(F.size("s") * threshold - 1e-9) + 1
    prefix = ordered.select("c", F.explode(F.slice("s", 1, few.cast("int"))).alias("x")).select("c", F.col("x.key").alias("key"))
    late = prefix.join(ranked.select("c", "grp", F.col("place").alias("lp"), F.col("keys").alias("lk"), F.col("m").alias("lm")), "c").withColumnRenamed("c", "later")
    early = held.join(ranked.select("c", F.col("place").alias("ep"), F.col("keys").alias("ek"), F.col("m").alias("em")), "c").withColumnRenamed("c", "earlier")
    both = F.size(F.array_intersect("lk", "ek"))
    within = (both == F.size("lk")) & (F.size("ek") > F.size("lk")) & (F.col("em") >= F.col("lm"))
    alike = both >= threshold * (F.size("lk") + F.size("ek") - both)
    met = late.join(early, ["grp", "key"]).where(F.col("ep") < F.col("lp"))
    return met.where(within | alike).select("later", "earlier").distinct()


def prune(candidates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """candidate_id, place of what survives pruning, in priority order.

    Combinations that the idea does not anchor go first. Then, within a category and pattern, a candidate goes if a kept one before it
    contains its basis with as many matches, or overlaps it by `threshold`. Candidates meet by rare keys; in rounds, those that none undecided
    before them can make go are kept, and what a kept one dominates goes. Each round settles at least the first undecided candidate of
    every chain, and a group of any size is spread over all tasks. Candidates without keys are kept.
    """
    rows = candidates.where((F.size("keys") <= 1) | (F.col("idea_anchor_score") > 0))
    order = Window.partitionBy("category", "pattern_type").orderBy(*priority())
    # Identifiers are names; numbers stand for them in the rounds.
    ranked = rows.withColumn("place", F.row_number().over(order)).select(
        "candidate_id", F.xxhash64("category", "pattern_type", "candidate_id").alias("c"), F.struct("category", "pattern_type").alias("grp"), "place", F.array_distinct("keys").alias("keys"), F.col("n_anchored").cast("int").alias("m"),
    )
    ranked = Staged(ranked, "ranked").df
    links = Staged(_dominance(ranked, threshold), "dominance").df
    gone = []
    while not links.isEmpty():
        # Nothing undecided stands before these: they are kept, and what they dominate goes.
        kept = links.select(F.col("earlier").alias("c")).distinct().join(links.select(F.col("later").alias("c")), "c", "left_anti")
        lost = Staged(links.join(kept, links["earlier"] == kept["c"], "left_semi").select(F.col("later").alias("c")).distinct(), "lost").df
        gone.append(lost)
        links = links.join(lost, links["later"] == lost["c"], "left_anti")
        links = Staged(links.join(lost, links["earlier"] == lost["c"], "left_anti"), "dominance").df
    out = ranked if not gone else ranked.join(reduce(DataFrame.unionByName, gone), "c", "left_anti")
    return out.select("candidate_id", "place")


def _filled(template: str, parts: dict[str, Column]) -> Column:
    out = []
    for piece in re.split(r"(\{\w+\})", template):
        out.append(parts[piece[1:-1]] if piece.startswith("{") else F.lit(piece))
    return F.concat(*out)


def combination_text(n: int) -> Column:
    """Title (n = 0) or description (n = 1) of a combination, from its basis in order (dims: dimension, value)."""
    dims = F.col("dims")
    left, right = dims[0], F.try_element_at(dims, F.lit(2))
    parts = {"left": left["value"], "right": right["value"], "all": F.array_join(F.transform("dims", lambda d: d["value"]), " + ")}
    text = F.when(F.size(dims) != 2, _filled(MORE_VALUES[n], parts))
    for (a, b), templates in PAIR_TEXTS.items():
        text = text.when((left["dimension"] == a) & (right["dimension"] == b), _filled(templates[n], parts))
    return text.otherwise(_filled(OTHER_PAIR[n], parts))


def generate(
    features: DataFrame, n_papers: int, frequency: DataFrame, members: DataFrame, claims: DataFrame, idea: DataFrame, idea_terms: Column,
    conflicts: DataFrame | None = None, titles: DataFrame | None = None, limit: int = MAX_CANDIDATES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, basis, support): what six builders propose, that two papers support and that bears on the idea, equal ones as one.

    The builders are conflicts (left_id, right_id, topic), repeated limitations and future work, unobserved combinations, a narrow setting, and missing
    comparisons. The first `limit` candidates stay, with the most supporting papers, then by pattern and title; they have n_support, idea_relevance,
    idea_anchor_score, and rank.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must lie between 1 and 50")
    names = named_values(claims)
    anchors = Staged(record_anchors(claims, idea, idea_terms, titles, names), "anchors").df
    values = idea_anchor(frequency, idea, idea_terms).select("dimension", "value", "count", "prevalence", "anchored")
    values = Staged(strong_context(values, members, claims, anchors), "values").df
    terms = idea.where(F.col("dimension").isin("problem", "population", "population_or_setting", "domain")).select(F.explode(f.gap_terms(F.col("value"))).alias("w")).distinct()
    near = claims.where(F.col("dimension").isin("problem", "population_or_setting")).select("paper_id", F.explode(f.gap_terms(F.concat_ws(" ", "value", "evidence_text"))).alias("w"))
    context = None if terms.isEmpty() else near.join(terms, "w", "left_semi").select("paper_id").distinct()
    built = [
        (*repeated_builder(members, values, "limitation"), "direct_support"), (*repeated_builder(members, values, "future_work"), "direct_support"),
        (*combination_builder(features, values, limit * 8), "contextual_support"), (*narrow_builder(members, values), "contextual_support"),
        (*comparison_builder(claims, members, values, idea, context, names), "contextual_support"),
    ]
    held, spoken = members.select("dimension", "value", "paper_id"), claims
    if conflicts is not None:
        rows, basis = conflict_candidates(conflicts, n_papers)
        basis = basis.withColumn("ord", F.col("ord").cast("long"))
        opposed = conflicts.select(F.lit("conflict").alias("dimension"), F.col("topic").alias("value"), F.explode(F.array("left_id", "right_id")).alias("paper_id")).distinct()
        named = idea_anchor(basis, idea, idea_terms)
        built.append((rows, strong_context(named, opposed, claims, anchors).select("candidate_id", "ord", "dimension", "value", "count", "prevalence", "anchored", "strong"), "direct_support"))
        held = held.unionByName(opposed)
        spoken = spoken.unionByName(claims.where("dimension = 'outcome'").withColumn("dimension", F.lit("conflict")))
    candidates = Staged(reduce(DataFrame.unionByName, [c.withColumn("role", F.lit(role)) for c, _, role in built]), "candidates").df
    basis = Staged(reduce(DataFrame.unionByName, [b for _, b, _ in built]), "basis").df
    fit = Staged(candidates.join(relevant(basis), "candidate_id", "left_semi"), "relevant").df
    borne = lambda of, role: basis.join(of.where(F.col("role") == role).select("candidate_id"), "candidate_id", "left_semi")
    # Candidates that papers support directly have values of their own; the others share few values, each of very many papers, so their support is counted, and made only of what stays.
    direct = Staged(collect_support(borne(fit, "direct_support"), spoken, held, "direct_support", names), "support").df
    counted = direct.groupBy("candidate_id").agg(F.countDistinct("paper_id").alias("n_support"), F.count(F.lit(1)).cast("int").alias("n_direct"))
    others = count_support(borne(fit, "contextual_support"), claims, members, names).withColumn("n_direct", F.lit(0))
    n = Staged(counted.unionByName(others), "counted").df
    kept = gate(fit, n.drop("n_direct"))
    kept = prioritise(relevance(kept, basis, idea_terms), basis)
    kept = Staged(kept.join(n.select("candidate_id", "n_direct"), "candidate_id"), "kept").df
    # All of them have a basis, so none is compared by its papers, and those are never gathered.
    none = F.array().cast("array<string>").alias("paper_ids")
    roots = consolidate(kept.select("candidate_id", "category", "pattern_type", "title", "description", "keys", none, "n_support", "n_direct"))
    first = kept.join(roots.where("candidate_id = root").select("candidate_id"), "candidate_id", "left_semi")
    # Candidates are few: a builder makes at most eight times `limit` combinations, and one row a repeated value or justified pair otherwise.
    order = [F.desc("n_support"), F.asc("pattern_type"), t.casefold(F.col("title")), F.asc("candidate_id")]
    best = first.orderBy(*order).limit(limit)
    best = Staged(best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))), "generated").df
    mine = lambda df: df.join(best.select("candidate_id"), "candidate_id", "left_semi")
    support = mine(direct).unionByName(collect_support(borne(best, "contextual_support"), claims, members, "contextual_support", names))
    return best.drop("n_direct", "role"), mine(basis), support
