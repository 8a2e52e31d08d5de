"""Verification of ideas and candidates against claims: prescreening, division by facets, labels.

claims: paper_id, field, value, evidence_text, source. requirements: idea_id, facet, grp, value: alternatives of a
group are rows with one grp; a paper meets a facet if every group is met by some claim (relational division).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import features as f
from siltstone.functions import text as t
from siltstone.operators import gaps
from siltstone.sources.staging import Staged

# Which fields speak for a facet, and which may support it.
PRIMARY = {
    "problem": ("research_objective",), "method": ("method_or_intervention",), "context": ("population_or_setting",),
    "data_or_modality": ("data_or_modality", "datasets"), "constraint": ("constraints",), "comparison": ("comparison_or_baseline",),
    "outcome": ("main_findings", "evaluation_metrics"),
}
CROSS = {
    "problem": ("research_objective", "population_or_setting", "method_or_intervention", "comparison_or_baseline", "data_or_modality", "datasets", "constraints"),
    "method": ("research_objective", "population_or_setting", "method_or_intervention", "comparison_or_baseline", "data_or_modality", "datasets", "main_findings"),
    "context": ("population_or_setting", "method_or_intervention", "data_or_modality", "datasets"),
    "data_or_modality": ("research_objective", "population_or_setting", "method_or_intervention", "data_or_modality", "datasets", "main_findings"),
    "constraint": ("research_objective", "population_or_setting", "method_or_intervention", "comparison_or_baseline", "datasets", "constraints"),
    "comparison": ("method_or_intervention", "comparison_or_baseline", "main_findings"),
    "outcome": ("research_objective", "main_findings", "evaluation_metrics"),
}
STRICT = {
    "problem": ("research_objective",), "method": ("method_or_intervention",), "method_family": ("method_or_intervention",), "population": ("population_or_setting",),
    "population_or_setting": ("population_or_setting",), "setting": ("population_or_setting",), "constraint": ("constraints",),
    "data_or_modality": ("data_or_modality", "datasets"), "dataset": ("datasets",), "baseline": ("comparison_or_baseline",), "comparison": ("comparison_or_baseline",),
    "metric": ("evaluation_metrics",), "performance_metric": ("evaluation_metrics",), "efficiency_metric": ("evaluation_metrics",), "outcome": ("main_findings",),
}
# Beyond STRICT, the dimensions that limitations and future work speak for, and those that any field may support.
SPOKEN = {"limitation": ("limitations",), "future_work": ("future_work",)}
SUPPORTED = ("problem", "method", "method_family", "population", "population_or_setting", "setting", "constraint", "data_or_modality")
NORMALISED = ("dataset", "metric", "performance_metric", "efficiency_metric")
VALID_DIMENSIONS = (
    "problem", "population_or_setting", "method", "method_family", "dataset", "dataset_type", "baseline", "performance_metric", "efficiency_metric",
    "constraint", "limitation", "future_work", "outcome",
)
VERB_FORMS = {
    "reduce": ("reduces", "reduced", "reducing", "reduction", "reductions", "decrease", "decreases", "decreased", "decreasing"),
    "improve": ("improves", "improved", "improving", "improvement", "improvements"),
    "increase": ("increases", "increased", "increasing"),
}
# Stopwords and generic words that no concept is made of. (Gap generation has a longer list of its own, in functions/features.py.)
STOPWORDS = (
    "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "under", "with",
)
BUCKETS = ("other", "unknown", "misc", "miscellaneous", "unspecified", "uncategorized", "none")
PLACEHOLDER = (
    r"\b(?:other|unknown|misc|miscellaneous|unspecified|uncategorized|none)(?:\s+(?:method|methods|model|models|approach|approaches|technique|techniques|"
    r"population|populations|setting|settings|dataset|datasets|data|baseline|baselines))?\b"
)
# Words that compare, that tell of a study done, and that settle a conflict.
COMPARING = (
    r"(?i)\b(?:compar(?:e|ed|es|ing|ison)|versus|vs|against|baseline|benchmark(?:ed|ing)?|outperform(?:s|ed|ing)?|underperform(?:s|ed|ing)?|better\s+than|"
    r"worse\s+than|superior\s+to|inferior\s+to)\b"
)
STUDY_ACTION = (
    r"(?i)\b(?:assess|assessed|compare|compared|deploy|deployed|evaluate|evaluated|implement|implemented|investigate|investigated|measure|measured|"
    r"replicate|replicated|test|tested|validate|validated)\b"
)
RESOLUTION = (
    r"(?i)\b(?:explain|explained|reconcile|reconciled|moderator|moderating|subgroup|heterogeneity|interaction|conditions?\s+(?:under|in which)|"
    r"source\s+of\s+(?:the\s+)?difference)\b"
)
# Words that say nothing of a candidate on their own, patterns that a study resolves, and the dimensions that may then name what it studies.
CONTEXT_GENERIC = (
    "method", "methods", "model", "models", "constraint", "constraints", "task", "study", "studies", "evaluation", "comparison", "dataset", "datasets",
    "population", "setting", "approach", "approaches",
)
RESOLVABLE = (
    "repeated_limitation", "repeated_future_work", "underrepresented_population", "limited_external_validation", "limited_real_world_validation",
    "evaluation_gap", "replication_gap", "method_domain_transfer",
)
RESOLVING_DIMENSIONS = (
    "limitation", "future_work", "problem", "population_or_setting", "method", "method_family", "constraint", "dataset", "dataset_type", "outcome",
)
EXPERIMENTAL = (
    "research_objective", "population_or_setting", "method_or_intervention", "comparison_or_baseline", "data_or_modality", "datasets",
    "evaluation_metrics", "main_findings", "constraints",
)
# The field that speaks for each facet of an idea when a record is asked whether it is about it.
TOPIC = {
    "problem": ("research_objective",), "population": ("population_or_setting",), "intervention_or_method": ("method_or_intervention",),
    "data_or_modality": ("data_or_modality", "datasets"),
}
STRONG_SCORE = 0.75
CAP = 4


def terms(c: Column) -> Column:
    """ASCII terms in order, without placeholders, stopwords and generic words."""
    text = F.regexp_replace(t.evidence_key(F.coalesce(c, F.lit(""))), PLACEHOLDER, " ")
    return F.filter(F.split(text, r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOPWORDS, *BUCKETS))


def stem(word: Column) -> Column:
    """A few verb forms in one, then the first suffix rule that fits."""
    formed = F.coalesce(*[F.when(word.isin(*forms), F.lit(root)) for root, forms in VERB_FORMS.items()], word)

    def suffix(w: Column) -> Column:
        n = F.length(w)
        cut = lambda k: F.left(w, n - k)
        return (
            F.when((n > 5) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
            .when((n > 6) & w.endswith("tion"), F.concat(cut(3), F.lit("t")))
            .when((n > 5) & w.endswith("ing"), cut(3))
            .when((n > 5) & w.endswith("ed"), cut(2))
            .when((n > 5) & w.endswith("s"), cut(1))
            .otherwise(w)
        )

    return t.let(formed, suffix)


def concepts(c: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(terms(c)), lambda w: stem(w)))


def phrase_matches(a: Column, b: Column) -> Column:
    """Either phrase's concepts contain the other's."""
    x, y = concepts(a), concepts(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def prescreen(papers: DataFrame, requirements: DataFrame, scores: DataFrame) -> DataFrame:
    """idea_id, paper_id, n_covered, verdict: accepted, uncertain or rejected, before extraction.

    A group is covered if all concepts of one alternative stand in title and abstract. papers: idea_id, paper_id, title, abstract; scores: idea_id,
    paper_id, score (pairs without one score 0). An idea with fewer than two papers, or without requirements, leaves its papers uncertain.
    """
    text = papers.select("idea_id", "paper_id", concepts(F.concat_ws(" ", "title", "abstract")).alias("c"))
    req = requirements.select("idea_id", "grp", concepts(F.col("value")).alias("need")).where(F.size("need") > 0).distinct()
    groups = req.groupBy("idea_id").agg(F.countDistinct("grp").alias("n_groups"))
    covered = text.join(req, "idea_id").where(F.size(F.array_except("need", "c")) == 0).groupBy("idea_id", "paper_id").agg(F.countDistinct("grp").alias("n_covered"))
    rows = papers.select("idea_id", "paper_id").join(covered, ["idea_id", "paper_id"], "left").join(scores, ["idea_id", "paper_id"], "left").join(groups, "idea_id", "left")
    size = papers.groupBy("idea_id").agg(F.count(F.lit(1)).alias("n_papers"))
    n, s = F.coalesce("n_covered", F.lit(0)), F.coalesce("score", F.lit(0.0))
    strong = s >= STRONG_SCORE
    verdict = (
        F.when((F.col("n_papers") < 2) | F.col("n_groups").isNull(), "uncertain")
        .when((n >= F.least(F.lit(2), F.col("n_groups"))) | ((n > 0) & strong), "accepted")
        .when((n > 0) | strong, "uncertain")
        .otherwise("rejected")
    )
    return rows.join(size, "idea_id").select("idea_id", "paper_id", n.alias("n_covered"), verdict.alias("verdict"))


def _field_table(fields: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def _within(x, y) -> Column:
    return F.size(F.array_except(x, y)) == 0


def _phrase(x, y) -> Column:
    """Whether either of two arrays of concepts, neither empty, contains the other."""
    return (F.size(x) > 0) & (F.size(y) > 0) & (_within(x, y) | _within(y, x))


def _small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df with a broadcast hint if a count shows it to have at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _wordings(claims: DataFrame) -> DataFrame:
    """field, value, evidence_text, have (concepts of both): many claims say the same, and each wording is compared once.

    The wordings are written once: else conditions on their concepts would move below the distinct, and concepts be found for every claim.
    """
    said = Staged(claims.select("field", "value", "evidence_text").distinct(), "wordings").df
    return said.withColumn("have", concepts(F.concat_ws(" ", "value", "evidence_text")))


def _stated(claims: DataFrame, met: DataFrame, *keep: str) -> DataFrame:
    """paper_id and the columns `keep` of met for every claim with one of its wordings (field, value, evidence_text).

    Wordings that meet something are few and each may be that of very many claims, so they are written, and broadcast if a count shows it.
    """
    met = met.select(F.col("field").alias("_f"), F.col("value").alias("_v"), F.col("evidence_text").alias("_e"), *keep).distinct()
    met = _small(Staged(met, "met").df)
    same = (F.col("field") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")) & F.col("evidence_text").eqNullSafe(F.col("_e"))
    # Shuffled by paper, so that what callers sort out or count for each paper needs no shuffle of its own.
    return claims.select("paper_id", "field", "value", "evidence_text").join(met, same).select("paper_id", *keep).repartition("paper_id").distinct()


def group_matches(claims: DataFrame, requirements: DataFrame) -> DataFrame:
    """idea_id, facet, grp, paper_id: requirement groups that some claim of the paper meets.

    A claim of a facet's own or supporting fields meets a value by phrase, value and evidence taken together.
    Requirements are an idea's few rows, broadcast if a count shows them to be at most 50,000.
    """
    fields = F.element_at(_field_table({k: (*PRIMARY[k], *(x for x in CROSS[k] if x not in PRIMARY[k])) for k in PRIMARY}), F.col("facet"))
    req = requirements.select("idea_id", "facet", "grp", concepts(F.col("value")).alias("need"), F.explode(fields).alias("field")).where(F.size("need") > 0).distinct()
    met = _wordings(claims).join(_small(req), "field").where(_phrase("need", "have"))
    return _stated(claims, met, "idea_id", "facet", "grp")


def topic_papers(idea: DataFrame, claims: DataFrame, idea_terms: Column | None = None, titles: DataFrame | None = None) -> DataFrame:
    """paper_id of papers whose records are about the idea (facet, value): some problem, population, method or modality of it is stated in its own field.

    An idea without any of these goes by its terms: papers whose title (paper_id, title) or claims share one of idea_terms.
    """
    kind = F.col("facet")
    fields = F.element_at(_field_table(TOPIC), kind)
    asked = idea.where(kind.isin(*TOPIC) & ((kind == "data_or_modality") | f.concrete_entity(F.col("value"))))
    need = asked.select(concepts(F.col("value")).alias("need"), F.explode(fields).alias("field"))
    if asked.isEmpty():
        if idea_terms is None:
            return claims.select("paper_id").limit(0)
        text = claims.select("paper_id", F.concat_ws(" ", "value", "evidence_text").alias("x"))
        if titles is not None:
            text = text.unionByName(titles.select("paper_id", F.col("title").alias("x")))
        return text.where(F.arrays_overlap(terms(F.col("x")), idea_terms)).select("paper_id").distinct()
    met = _wordings(claims).join(_small(need.distinct()), "field").where(_phrase("need", "have"))
    return _stated(claims, met)


def facet_matches(matched: DataFrame, requirements: DataFrame) -> DataFrame:
    """idea_id, facet, paper_id of facets whose groups a paper meets one and all."""
    asked = requirements.groupBy("idea_id", "facet").agg(F.countDistinct("grp").alias("n"))
    got = matched.groupBy("idea_id", "facet", "paper_id").agg(F.countDistinct("grp").alias("k"))
    return got.join(asked, ["idea_id", "facet"]).where("k = n").select("idea_id", "facet", "paper_id")


def match_strength(matched: DataFrame, requirements: DataFrame) -> DataFrame:
    """idea_id, paper_id, facets, complete: whether one paper meets all facets of the idea."""
    asked = requirements.groupBy("idea_id").agg(F.countDistinct("facet").alias("n"))
    got = facet_matches(matched, requirements).groupBy("idea_id", "paper_id").agg(F.array_sort(F.collect_set("facet")).alias("facets"))
    return got.join(asked, "idea_id").select("idea_id", "paper_id", "facets", (F.size("facets") == F.col("n")).alias("complete"))


def coverage(matched: DataFrame, requirements: DataFrame, n_papers: DataFrame) -> DataFrame:
    """idea_id, missing (facets with a group that no paper meets), covered. n_papers: idea_id, n; two papers are needed at least."""
    met = matched.select("idea_id", "facet", "grp").distinct().withColumn("ok", F.lit(1))
    rows = requirements.select("idea_id", "facet", "grp").distinct().join(met, ["idea_id", "facet", "grp"], "left")
    by = rows.groupBy("idea_id").agg(F.array_sort(F.collect_set(F.when(F.col("ok").isNull(), F.col("facet")))).alias("missing"))
    return by.join(n_papers, "idea_id", "left").select("idea_id", "missing", ((F.size("missing") == 0) & (F.coalesce("n", F.lit(0)) >= 2)).alias("covered"))


def idea_label(rows: DataFrame) -> DataFrame:
    """rows: direct, partial, potential, failures (counts), n_papers, covered, n_landscape. With label.

    A direct match decides before failures do; any doubt is uncertain; promising needs coverage and two analysed papers.
    """
    doubt = (F.col("failures") > 0) | ~F.col("covered") | (F.col("n_papers") == 0) | (F.col("partial") + F.col("potential") > 0)
    label = F.when(F.col("direct") > 0, "well_studied").when(doubt, "uncertain").when(F.col("n_landscape") >= 2, "promising_gap").otherwise("uncertain")
    return rows.withColumn("label", label)


def candidate_label(rows: DataFrame) -> DataFrame:
    """rows: failures, n_papers, n_records, n_with_abstract, confirmed, potential (counts). With label; here failures decide first."""
    none_usable = (F.col("n_papers") > 0) & ((F.col("n_records") == 0) | (F.col("n_with_abstract") == 0))
    label = (
        F.when((F.col("failures") > 0) | none_usable, "uncertain")
        .when(F.col("confirmed") > 0, "well_studied")
        .when((F.col("potential") > 0) | (F.col("n_papers") == 0), "uncertain")
        .otherwise("promising_gap")
    )
    return rows.withColumn("label", label)


def _basis_met(basis: DataFrame, claims: DataFrame, strict: bool = True) -> DataFrame:
    """candidate_id, paper_id, dimension, value: basis values that a claim states.

    Datasets and metrics compare normalised, all else by phrase of value and evidence together. Strictly, a value is stated only in its own role; else
    limitations and future work count in theirs, and problems, methods, settings, constraints and modalities also where any claim holds all their concepts.
    """
    norm = lambda c: f.normalised(F.col("dimension"), F.col(c))
    roles = STRICT if strict else STRICT | SPOKEN
    want = basis.select("candidate_id", "dimension", F.col("value").alias("want")).distinct()
    wanted = want.select("dimension", "want").distinct().select("*", concepts(F.col("want")).alias("need"), norm("want").alias("n"))
    said = _wordings(claims)
    by_field = _small(wanted.select("*", F.explode(F.element_at(_field_table(roles), F.col("dimension"))).alias("field")))
    exact = F.col("dimension").isin(*NORMALISED)
    met = said.join(by_field, "field").where(F.when(exact, (F.col("n") != "") & (F.col("n") == norm("value"))).otherwise(_phrase("need", "have")))
    met = met.select("field", "value", "evidence_text", "dimension", "want")
    if not strict:
        first = _small(wanted.where(F.col("dimension").isin(*SUPPORTED) & (F.size("need") > 0)).withColumn("_t", F.col("need")[0]))
        held = said.withColumn("_t", F.explode("have")).join(first, "_t").where(_within("need", "have"))
        met = met.unionByName(held.select("field", "value", "evidence_text", "dimension", "want"))
    stated = _stated(claims, met, "dimension", "want")
    return stated.join(_small(want), ["dimension", "want"]).select("candidate_id", "paper_id", "dimension", F.col("want").alias("value")).distinct()


def _all_met(basis: DataFrame, claims: DataFrame, strict: bool) -> DataFrame:
    """candidate_id, paper_id: papers that state every concrete basis value, of two at least."""
    solid = basis.where(f.concrete_entity(F.col("value"))).select("candidate_id", "dimension", "value").distinct()
    asked = solid.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    got = _basis_met(solid, claims, strict).groupBy("candidate_id", "paper_id").agg(F.count(F.lit(1)).alias("k"))
    return got.join(_small(asked), "candidate_id").where("k = n").select("candidate_id", "paper_id")


def observed(basis: DataFrame, claims: DataFrame) -> DataFrame:
    """candidate_id, paper_id: papers that state every concrete basis value (two at least) in its own role."""
    return _all_met(basis, claims, True)


def eligible(candidates: DataFrame, basis: DataFrame) -> DataFrame:
    """Candidates whose basis has valid dimensions only (study types and conflicts have none), anchored if they combine values."""
    bad = basis.where(~F.col("dimension").isin(*VALID_DIMENSIONS)).select("candidate_id").distinct()
    n = basis.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = candidates.join(bad, "candidate_id", "left_anti").join(n, "candidate_id", "left")
    return rows.where((F.coalesce("_n", F.lit(0)) <= 1) | (F.col("idea_anchor_score") > 0)).drop("_n")


def select_for_verification(candidates: DataFrame, pruned: DataFrame, seen: DataFrame, cap: int = CAP) -> DataFrame:
    """The first `cap` pruned candidates of all groups in the order of priority, less the combinations that a paper already shows.

    candidates: as gaps.prioritise leaves them.
    """
    rows = candidates.join(pruned.select("candidate_id"), "candidate_id", "left_semi").orderBy(*gaps.priority()).limit(cap)
    shown = seen.select(F.col("candidate_id").alias("_seen")).distinct()
    return rows.join(shown, (F.col("pattern_type") == "combination_gap") & (F.col("candidate_id") == F.col("_seen")), "left_anti")


def _compared(basis: DataFrame, claims: DataFrame) -> DataFrame:
    """candidate_id, paper_id: papers that compare all method families of a candidate.

    Either its methods and its baselines name them between them, some of them on each side; or one claim on methods, baselines or findings has a
    comparing word and, for each family, the words by which the paper names it.
    """
    fam = basis.where(F.col("dimension").isin("method", "method_family") & f.concrete_entity(F.col("value")))
    fam = fam.select("candidate_id", f.method(F.col("value")).alias("fam")).where("fam != ''").distinct()
    asked = fam.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    own = claims.where(F.col("field").isin("method_or_intervention", "comparison_or_baseline") & f.concrete_entity(F.col("value")))
    own = own.select("paper_id", "field", "value", f.method(F.col("value")).alias("fam")).distinct()
    met = fam.join(own, "fam").join(asked, "candidate_id")
    sides = [F.count_if(F.col("field") == x) for x in ("method_or_intervention", "comparison_or_baseline")]
    both = met.groupBy("candidate_id", "paper_id").agg(F.countDistinct("fam").alias("k"), F.max("n").alias("n"), sides[0].alias("m"), sides[1].alias("b")).where("k = n")
    direct = both.where("m > 0 and b > 0").select("candidate_id", "paper_id")
    spoken = claims.where(F.col("field").isin("method_or_intervention", "comparison_or_baseline", "main_findings") & F.concat_ws(" ", "value", "evidence_text").rlike(COMPARING))
    spoken = spoken.select("paper_id", F.col("value").alias("v"), F.col("evidence_text").alias("e"), concepts(F.concat_ws(" ", "value", "evidence_text")).alias("have")).distinct()
    named = met.select("candidate_id", "paper_id", "fam", "n", concepts(F.col("value")).alias("need")).distinct()
    told = named.join(both.where("m = 0 or b = 0").select("candidate_id", "paper_id"), ["candidate_id", "paper_id"], "left_semi")
    told = told.join(spoken, "paper_id").where(_phrase("need", "have")).groupBy("candidate_id", "paper_id", "v", "e")
    told = told.agg(F.countDistinct("fam").alias("k"), F.max("n").alias("n")).where("k = n").select("candidate_id", "paper_id")
    return direct.unionByName(told).distinct()


def _record_text(claims: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """paper_id, body: the paper's claims of these fields in one text. A paper has few claims."""
    said = claims.where(F.col("field").isin(*fields)).groupBy("paper_id")
    return said.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "value", "evidence_text"))), " ").alias("body"))


def _resolved(candidates: DataFrame, basis: DataFrame, claims: DataFrame) -> DataFrame:
    """candidate_id, paper_id: papers whose experimental claims tell of a study done and hold a basis value, or the title where none may name what is studied."""
    of = candidates.where(F.col("pattern_type").isin(*RESOLVABLE)).select("candidate_id", "title")
    named = basis.where(F.col("dimension").isin(*RESOLVING_DIMENSIONS)).join(of, "candidate_id", "left_semi").select("candidate_id", "value")
    bare = of.join(named.select("candidate_id").distinct(), "candidate_id", "left_anti").select("candidate_id", F.col("title").alias("value"))
    need = named.unionByName(bare).select("candidate_id", concepts(F.col("value")).alias("need")).where(F.size("need") > 0).distinct()
    acted = _record_text(claims, EXPERIMENTAL).where(F.col("body").rlike(STUDY_ACTION)).select("paper_id", concepts(F.col("body")).alias("have")).where(F.size("have") > 0)
    # One contains the other, so the first concept of the smaller is one of the larger's.
    inner = need.withColumn("_t", F.col("need")[0]).join(acted.withColumn("_t", F.explode("have")), "_t").where(_within("need", "have"))
    outer = need.withColumn("_t", F.explode("need")).join(acted.withColumn("_t", F.col("have")[0]), "_t").where(_within("have", "need"))
    return inner.select("candidate_id", "paper_id").unionByName(outer.select("candidate_id", "paper_id")).distinct()


def _settled(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """candidate_id, paper_id: papers whose experimental claims settle a conflict and share a term of its title."""
    body = _record_text(claims, EXPERIMENTAL).where(F.col("body").rlike(RESOLUTION)).select("paper_id", F.explode(F.array_distinct(terms(F.col("body")))).alias("w"))
    titles = candidates.where("pattern_type = 'comparable_conflict'").select("candidate_id", F.explode(F.array_distinct(terms(F.col("title")))).alias("w"))
    return titles.join(body, "w").select("candidate_id", "paper_id").distinct()


def direct_counterexamples(candidates: DataFrame, basis: DataFrame, claims: DataFrame, topical: DataFrame) -> DataFrame:
    """candidate_id, paper_id of papers about the idea (topical: paper_id) that answer a candidate by its own pattern.

    A combination: every concrete basis value, two at least, each in its role or held by a claim. A missing comparison: see _compared. Limitations, future
    work, validation, replication and transfer: see _resolved. A conflict: see _settled. A narrow setting needs dataset types, which are never inferred, so
    none is confirmed; nor are other patterns.
    """
    of = lambda pattern: basis.join(candidates.where(F.col("pattern_type") == pattern).select("candidate_id"), "candidate_id", "left_semi")
    # Claims are read for the patterns that there are; patterns are a fixed few.
    there = {r["pattern_type"] for r in candidates.select("pattern_type").distinct().collect()}
    ways = [
        (("combination_gap",), lambda: _all_met(of("combination_gap"), claims, False)), (("missing_comparison",), lambda: _compared(of("missing_comparison"), claims)),
        (RESOLVABLE, lambda: _resolved(candidates, basis, claims)), (("comparable_conflict",), lambda: _settled(candidates, claims)),
    ]
    asked = [way() for patterns, way in ways if there.intersection(patterns)]
    if not asked:
        return candidates.select("candidate_id").limit(0).crossJoin(topical.select("paper_id"))
    found = reduce(DataFrame.unionByName, asked)
    return found.join(topical.select("paper_id").distinct(), "paper_id", "left_semi").select("candidate_id", "paper_id").distinct()


def _candidate_text(candidates: DataFrame) -> Column:
    return F.concat_ws(" ", "title", *(["description"] if "description" in candidates.columns else []))


def contextual(candidates: DataFrame, basis: DataFrame, claims: DataFrame, topical: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """candidate_id, paper_id: papers about the idea that bear on a candidate without having to confirm it.

    With concrete basis values one of them must be stated; without, two terms of title and description that are not generic must stand in the record
    (its claims, and its title where titles has paper_id, title).
    """
    solid = basis.where(f.concrete_entity(F.col("value")))
    stated = _basis_met(solid, claims, False).select("candidate_id", "paper_id").distinct()
    telling = lambda c: F.array_distinct(F.filter(terms(c), lambda w: ~w.isin(*CONTEXT_GENERIC)))
    bare = candidates.join(solid.select("candidate_id").distinct(), "candidate_id", "left_anti")
    asked = bare.select("candidate_id", F.explode(telling(_candidate_text(candidates))).alias("w"))
    text = claims.select("paper_id", F.concat_ws(" ", "value", "evidence_text").alias("x"))
    if titles is not None:
        text = text.unionByName(titles.select("paper_id", F.col("title").alias("x")))
    have = text.select("paper_id", F.explode(telling(F.col("x"))).alias("w")).distinct()
    shared = asked.join(have, "w").groupBy("candidate_id", "paper_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("candidate_id", "paper_id")
    return stated.unionByName(shared).join(topical.select("paper_id").distinct(), "paper_id", "left_semi").select("candidate_id", "paper_id").distinct()


def title_matches(candidates: DataFrame, basis: DataFrame, titles: DataFrame) -> DataFrame:
    """candidate_id, paper_id: papers (paper_id, title) whose title alone holds two to four terms of title, description and basis, as many as there are."""
    values = basis.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("value")), " ").alias("b"))
    asked = candidates.join(values, "candidate_id", "left").select("candidate_id", F.array_distinct(terms(F.concat_ws(" ", _candidate_text(candidates), "b"))).alias("need"))
    asked = asked.select("candidate_id", F.greatest(F.lit(2), F.least(F.lit(4), F.size("need"))).alias("least"), F.explode("need").alias("w"))
    have = titles.select("paper_id", F.explode(F.array_distinct(terms(F.col("title")))).alias("w")).distinct()
    met = asked.join(have, "w").groupBy("candidate_id", "paper_id", "least").agg(F.count(F.lit(1)).alias("k"))
    return met.where("k >= least").select("candidate_id", "paper_id")


def idea_title_matches(idea_terms: Column, titles: DataFrame) -> DataFrame:
    """paper_id of papers whose title holds two terms of the idea at least."""
    return titles.where(F.size(F.array_intersect(F.array_distinct(terms(F.col("title"))), idea_terms)) >= 2).select("paper_id").distinct()


def apply_labels(candidates: DataFrame, labels: DataFrame, contradicting: DataFrame) -> DataFrame:
    """candidates with final_label and contradicting_paper_ids; candidates that were not verified keep a null label."""
    ids = contradicting.groupBy("candidate_id").agg(F.array_sort(F.collect_set("paper_id")).alias("contradicting_paper_ids"))
    return candidates.join(labels.select("candidate_id", F.col("label").alias("final_label")), "candidate_id", "left").join(ids, "candidate_id", "left")
