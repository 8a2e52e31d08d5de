"""Normalisation of claim values into landscape features, and guards on claims, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as t

# Fixed values.
EFFICIENCY_TERMS = (
    "latency", "inference time", "training time", "execution time", "runtime", "throughput", "memory usage",
    "memory consumption", "energy consumption", "power consumption", "parameter count", "number of parameters",
    "model size", "flops", "computational cost", "compute cost",
)
GENERIC_METHODS = (
    "method", "methods", "model", "models", "approach", "approaches", "technique", "techniques", "algorithm",
    "algorithms", "architecture", "architectures", "framework", "frameworks", "proposed method", "proposed model",
    "our method", "our model",
)
GENERIC_BUCKETS = (
    "", "other", "unknown", "misc", "miscellaneous", "unspecified", "uncategorized", "none", "not specified",
    "not reported", "baseline", "method", "methods", "model", "models", "approach", "approaches", "technique",
    "techniques", "dataset", "datasets", "setting", "settings", "population", "populations",
)
GENERIC_PREFIXES = ("other", "unknown", "misc", "miscellaneous", "unspecified", "uncategorized")
GENERIC_DATASET = (
    r"^(?:dataset|datasets|data|benchmark|benchmark datasets?|public datasets?|private datasets?|custom datasets?|"
    r"proprietary datasets?|several datasets?|multiple datasets?|various datasets?|different datasets?|"
    r"several public datasets?|multiple public datasets?|widely used datasets?)$"
)
SENTENCE_LIKE = (
    r"\b(?:we|this paper|this study|our work|the authors|propose|proposes|proposed|develop|developed|evaluate|evaluated|"
    r"investigate|investigated|achieve|achieved|outperform|outperformed|using|used to)\b"
)
REVIEW = r"(?i)\b(?:systematic review|scoping review|literature review|review|survey|meta analysis)\b"
POSITIVE_FINDING = (
    r"\b(?:outperform(?:s|ed|ing)?|perform(?:s|ed)?\s+better\s+than|better\s+than|superior\s+to|significantly\s+better\s+than|"
    r"significantly\s+outperform(?:s|ed)?|improv(?:e|es|ed|ing)\s+(?:over|upon|compared\s+with|compared\s+to)|"
    r"significant(?:ly)?\s+improv(?:e|es|ed|ement))\b"
)
NEGATIVE_FINDING = (
    r"\b(?:underperform(?:s|ed|ing)?|perform(?:s|ed)?\s+worse\s+than|worse\s+than|inferior\s+to|does\s+not\s+outperform|"
    r"did\s+not\s+outperform|fails?\s+to\s+outperform|failed\s+to\s+outperform|does\s+not\s+improve|did\s+not\s+improve|"
    r"fails?\s+to\s+improve|failed\s+to\s+improve|no\s+significant\s+improvement|no\s+improvement)\b"
)
LIMITED_LABELS = (
    r"\b(?:limited\s+labeled\s+data|few\s+shot|label\s+scarcity|annotation\s+scarcity|label\s+budget|annotation\s+budget)\b"
)
GENERALISATION = r"\b(?:generalization|generalisation|external\s+validation|out\s+of\s+distribution|cross\s+domain)\b"
EFFICIENCY = (
    r"\b(?:efficiency|inference\s+time|training\s+time|latency|computational\s+cost|memory\s+usage|parameter\s+count|flops)\b"
)
GAP_STOPWORDS = (
    "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "under", "with",
)


def _concrete(key: Column, words: int = 12) -> Column:
    n = F.size(F.split(key, " "))
    fine = ~key.isin(*t.SENTINELS) & (n <= words) & ~key.rlike(SENTENCE_LIKE) & key.rlike(r"\p{L}")
    return F.when(fine, key).otherwise(F.lit(""))


def problem(c: Column) -> Column:
    return t.let(t.evidence_key(c), _concrete)


constraint = problem


def metric(c: Column) -> Column:
    return t.let(t.evidence_key(c), lambda k: _concrete(k, 6))


def metric_kind(c: Column) -> Column:
    """`efficiency`, `performance`, or null for no valid metric."""
    found = F.array(*map(F.lit, EFFICIENCY_TERMS))
    return t.let(
        metric(c),
        lambda m: F.when(m == "", None).when(F.exists(found, lambda x: m.contains(x)), "efficiency").otherwise("performance"),
    )


def method(c: Column) -> Column:
    def strip(key: Column) -> Column:
        bare = F.trim(F.regexp_replace(key, r"\b(?:model|models|architecture|architectures)$", ""))
        return F.when(key.isin(*GENERIC_METHODS) | bare.isin(*GENERIC_METHODS), "").otherwise(bare)

    return t.let(t.evidence_key(c), strip)


def dataset(c: Column) -> Column:
    def strip(key: Column) -> Column:
        bare = F.trim(F.regexp_replace(key, r"\s+(?:dataset|datasets|corpus|cohort)$", ""))
        return F.when(key.rlike(GENERIC_DATASET) | bare.rlike(GENERIC_DATASET), "").otherwise(_concrete(bare))

    return t.let(t.evidence_key(c), strip)


def normalised(dimension: Column, value: Column) -> Column:
    """The value as its dimension compares it."""
    return (
        F.when(dimension.isin("method", "method_family", "baseline", "comparison"), method(value))
        .when(dimension == "dataset", dataset(value))
        .when(dimension.isin("problem", "constraint"), problem(value))
        .when(dimension.isin("performance_metric", "efficiency_metric"), metric(value))
        .otherwise(t.evidence_key(value))
    )


def concrete_entity(c: Column) -> Column:
    """Not a placeholder: neither a generic bucket nor led by a generic word."""
    return t.let(t.evidence_key(c), lambda k: ~k.isin(*GENERIC_BUCKETS) & ~F.split(k, " ").getItem(0).isin(*GENERIC_PREFIXES))


def study_type(text: Column, declared: Column) -> Column:
    known = F.when(declared.isin("empirical", "review", "survey", "methodological"), declared).otherwise("other")
    return F.when(text.rlike(r"(?i)\bsurvey\b"), "survey").when(text.rlike(REVIEW), "review").otherwise(known)


def polarity(finding: Column) -> Column:
    """-1 or 1 for explicit comparisons, negative wording first; else null."""
    text = F.lower(finding)
    return F.when(text.rlike(NEGATIVE_FINDING), -1).when(text.rlike(POSITIVE_FINDING), 1)


def gap_terms(c: Column) -> Column:
    """Distinct ASCII terms without stopwords."""
    words = F.split(t.evidence_key(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*GAP_STOPWORDS)))


def semantic_guard(claim: Column, field: Column, value: Column, evidence: Column) -> Column:
    """Whether evidence may stand for a claim: label scarcity, sample sizes, generalisation and efficiency are checked."""
    key = t.evidence_key(claim)
    text = t.evidence_key(F.concat_ws(" ", value, evidence))
    name = F.replace(F.lower(field), F.lit(" "), F.lit("_"))
    label_ok = name.isin("constraint", "constraints") & (constraint(value) == constraint(claim))
    counted = text.rlike(r"\b(?:samples?|participants?|patients?|records?|instances?|examples?|images?|documents?)\b")
    measured = name.isin("evaluation", "evaluation_metrics", "metric", "metrics") & text.rlike(
        r"\b(?:time|latency|cost|flops?|parameters?|memory|overhead|complexity)\b"
    )
    return (
        (text != "")
        & (~key.rlike(LIMITED_LABELS) | label_ok)
        & ~((name == "sample_size") & text.rlike(r"\bclasses?\b") & ~counted)
        & (~key.rlike(GENERALISATION) | text.rlike(GENERALISATION))
        & (~key.rlike(EFFICIENCY) | measured)
    )


def unguarded(claim: Column, field: Column) -> Column:
    """Whether semantic_guard lets any evidence with a wording stand for a claim."""
    looked_at = t.let(t.evidence_key(claim), lambda key: key.rlike(LIMITED_LABELS) | key.rlike(GENERALISATION) | key.rlike(EFFICIENCY))
    return ~looked_at & (F.replace(F.lower(field), F.lit(" "), F.lit("_")) != "sample_size")
