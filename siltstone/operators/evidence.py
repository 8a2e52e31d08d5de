"""Claims and their evidence: support checks, cleaning rules, coverage.

claims is the central long table: paper_id, field, ord, value, canonical_value, evidence_text, source,
confidence, section_id, section_heading, section_type, role (methods), author_stated (limitations). papers:
paper_id, title, abstract. sections: paper_id, section_id, heading, section_types, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as t

# Fixed values.
GENERIC_DATASETS = (
    "dataset", "datasets", "benchmark dataset", "benchmark datasets", "widely used dataset", "widely used datasets",
    "widely used benchmark dataset", "widely used benchmark datasets", "public dataset", "public datasets",
)
EXPLICIT_COMPARISON = (
    r"(?i)\b(?:compar(?:e|ed|ing|ison)|benchmark(?:ed|s)?|evaluat(?:e|ed|ing)|test(?:ed|s|ing)?|outperform(?:ed|s|ing)?|"
    r"against|versus|vs\.?|baseline|relative to)\b"
)
BACKGROUND_COMPARISON = (
    r"(?i)\b(?:background|related work|prior work|conventional|traditional|existing approaches?|limitations?|slow|expensive|"
    r"challenging|shortcomings?)\b"
)
METHOD_DETAIL = (
    r"(?i)\b(?:implementation detail|preprocessing|pre-processing|data augmentation|normalization|filtering|"
    r"learning[- ]rate scheduling|hyperparameter tuning|postprocessing|post-processing)\b"
)
SAMPLE_SIZE = (
    r"(?i)\b(?:dataset|subset|test set|training set|validation set|sample|cohort)[^.!?]{0,40}?\b(?:of|with|containing|consisting of)?\s*"
    r"(\d[\d,]*)\s+(images?|samples?|participants?|patients?|documents?|records?|instances?|examples?)\b"
)
FUTURE_ACTION = (
    r"(?i)\b(?:assess|adapt|analy[sz]e|apply|benchmark|collect|compare|conduct|develop|deploy|design|evaluate|examine|extend|explore|"
    r"improve|implement|investigate|measure|study|test|validate)\w*\b"
)
SINGLE_FIELDS = ("research_objective", "sample_size")
FULL_TEXT = "full_text"


def folded(c: Column) -> Column:
    return t.collapse(t.casefold(c))


def with_failure(claims: DataFrame, papers: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """claims with failure: why the declared source does not hold the quoted text, or null if it does.

    `incorrect_section_provenance`: a full-text claim whose section is not known, or has another heading or
    role; `unsupported_quotation`: the source lacks the quotation, white space and case aside.
    """
    meta = papers.select("paper_id", "title", "abstract")
    rows = claims.join(meta, "paper_id", "left")
    if sections is None:
        rows = rows.withColumns({"_h": F.lit(None).cast("string"), "_r": F.array().cast("array<string>"), "_t": F.lit(None).cast("string")})
    else:
        sec = sections.select("paper_id", "section_id", F.col("heading").alias("_h"), F.col("section_types").alias("_r"), F.col("text").alias("_t"))
        rows = rows.join(sec, ["paper_id", "section_id"], "left")
    body = F.when(F.col("source") == "title", F.col("title")).when(F.col("source") == "abstract", F.coalesce("abstract", F.lit(""))).otherwise(F.col("_t"))
    placed = (F.col("section_heading") == F.col("_h")) & F.array_contains("_r", F.col("section_type"))
    wrong = ~F.col("source").isin("title", "abstract") & ~F.coalesce(placed, F.lit(False))
    held = F.contains(folded(F.coalesce(body, F.lit(""))), folded(F.col("evidence_text")))
    failure = F.when(wrong, "incorrect_section_provenance").when(~held, "unsupported_quotation")
    return rows.withColumn("failure", failure).drop("_h", "_r", "_t", "title", "abstract")


def rejections(marked: DataFrame) -> DataFrame:
    return marked.where("failure is not null").groupBy("paper_id", "failure").agg(F.count(F.lit(1)).alias("n"))


def claim_key() -> Column:
    return t.evidence_key(F.coalesce("canonical_value", "value"))


def first_by_key(rows: DataFrame, key: Column, by: tuple[str, ...] = ("paper_id", "field")) -> DataFrame:
    w = Window.partitionBy(*by, "_key").orderBy("ord")
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def clean(claims: DataFrame, papers: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """The claims that count as evidence, with the fields they end in.

    Supported claims only, the first of each key. Methods split by role: primary ones stay (implementation
    details go where another remains), comparing ones join the comparisons, supporting ones go; comparisons that
    are background only or name a primary method go; so do constraints that name a method or comparison,
    generic datasets, limitations the authors did not state, and future work without an action. A missing
    sample size is read from the abstract.
    """
    good = with_failure(claims, papers, sections).where("failure is null").drop("failure")
    is_method = F.col("field") == "method_or_intervention"
    plain = good.where(~F.col("field").isin("method_or_intervention", "comparison_or_baseline", "constraints", "limitations"))
    plain = plain.where(~((F.col("field") == "datasets") & claim_key().isin(*GENERIC_DATASETS)))
    plain = plain.where((F.col("field") != "future_work") | F.col("evidence_text").rlike(FUTURE_ACTION))
    plain = first_by_key(plain, claim_key())
    stated = good.where((F.col("field") == "limitations") & F.col("author_stated"))

    primary = first_by_key(good.where(is_method & (F.col("role") == "primary")), claim_key())
    detail = F.col("value").rlike(METHOD_DETAIL)
    w = Window.partitionBy("paper_id")
    own_key = t.evidence_key(F.col("value"))
    primary = primary.withColumns({"_d": detail, "_k": own_key}).withColumns({"_n": F.count_if("_d").over(w), "_all": F.count(F.lit(1)).over(w)})
    primary = primary.withColumn("_dk", F.max(F.col("_d").cast("int")).over(Window.partitionBy("paper_id", "_k")))
    primary = primary.where((F.col("_all") < 2) | (F.col("_n") == 0) | (F.col("_n") == F.col("_all")) | (F.col("_dk") == 0)).drop("_d", "_n", "_all", "_dk")

    explicit = F.col("evidence_text").rlike(EXPLICIT_COMPARISON) | ~F.col("evidence_text").rlike(BACKGROUND_COMPARISON)
    by_role = first_by_key(good.where(is_method & (F.col("role") == "comparison") & explicit), claim_key()).withColumn("_o", F.lit(0))
    by_field = first_by_key(good.where((F.col("field") == "comparison_or_baseline") & explicit), claim_key()).withColumn("_o", F.lit(1))
    compared = by_role.unionByName(by_field).withColumn("_k", own_key)
    compared = compared.join(primary.select("paper_id", "_k"), ["paper_id", "_k"], "left_anti").withColumn("field", F.lit("comparison_or_baseline"))
    first = F.row_number().over(Window.partitionBy("paper_id", "_k").orderBy("_o", "ord"))
    compared = compared.withColumn("_n", first).where("_n = 1").drop("_n", "_o")

    entities = primary.select("paper_id", "_k").unionByName(compared.select("paper_id", "_k")).distinct()
    limits = first_by_key(good.where("field = 'constraints'"), claim_key()).withColumn("_k", own_key)
    limits = limits.join(entities, ["paper_id", "_k"], "left_anti").drop("_k")

    columns = claims.columns
    out = plain.unionByName(stated).unionByName(primary.drop("_k")).unionByName(compared.drop("_k")).unionByName(limits).select(columns)
    return out.unionByName(_sizes_from_abstracts(out, papers, columns), allowMissingColumns=True)


def _sizes_from_abstracts(kept: DataFrame, papers: DataFrame, columns: list[str]) -> DataFrame:
    have = kept.where("field = 'sample_size'").select("paper_id").distinct()
    lacking = papers.join(have, "paper_id", "left_anti").where(F.col("abstract").rlike(SAMPLE_SIZE))
    part = lambda i: F.regexp_extract("abstract", SAMPLE_SIZE, i)
    return lacking.select(
        "paper_id", F.lit("sample_size").alias("field"), F.lit(0).cast("int").alias("ord"), F.concat_ws(" ", part(1), part(2)).alias("value"),
        part(0).alias("evidence_text"), F.lit("abstract").alias("source"), F.lit(0.95).alias("confidence"),
    )


def repair_provenance(claims: DataFrame, papers: DataFrame, full_text_allowed: bool) -> DataFrame:
    """claims with usable sources, and `repaired` where something changed.

    Where full text may not be used, claims from it move to the title or else the abstract that holds the quotation, or go;
    claims from titles and abstracts lose section fields.
    """
    fields = ("section_id", "section_heading", "section_type")
    rows = claims.join(papers.select("paper_id", F.col("title").alias("_t"), F.col("abstract").alias("_a")), "paper_id", "left")
    quote = folded(F.col("evidence_text"))
    holds = lambda c: (quote != "") & F.contains(folded(F.coalesce(c, F.lit(""))), quote)
    home = F.when(holds(F.col("_t")), "title").when(holds(F.col("_a")), "abstract")
    foreign = (F.col("source") == FULL_TEXT) & F.lit(not full_text_allowed)
    rows = rows.withColumns({"_moved": foreign, "_s": F.when(foreign, home).otherwise(F.col("source"))}).where("_s is not null")
    local = F.col("_s").isin("title", "abstract")
    had = F.greatest(*[F.col(c).isNotNull() for c in fields])
    cleared = {c: F.when(~local, F.col(c)) for c in fields}
    out = rows.withColumn("repaired", F.col("_moved") | (local & had)).withColumns(cleared).withColumn("source", F.col("_s"))
    return out.select(*claims.columns, "repaired")


def coverage(requested: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per requested paper: source_level, full_text_status, n_claims, final_state.

    requested: paper_id, has_abstract, full_text_requested. documents: paper_id, status. full_text if any claim
    comes from it; abstract_fallback if full text was asked for in vain; metadata_only without an abstract.
    """
    by = claims.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == FULL_TEXT).alias("n_full"))
    rows = requested.join(by, "paper_id", "left").join(documents.select("paper_id", "status"), "paper_id", "left")
    status = F.coalesce("status", F.lit("not_attempted"))
    level = (
        F.when(F.col("n").isNull(), "none")
        .when(F.col("n_full") > 0, "full_text")
        .when(F.col("full_text_requested") & F.col("has_abstract"), "abstract_fallback")
        .when(F.col("has_abstract"), "abstract")
        .otherwise("metadata_only")
    )
    return rows.select(
        "paper_id", level.alias("source_level"), status.alias("full_text_status"), F.coalesce("n", F.lit(0)).alias("n_claims"),
        F.when(F.col("n").isNull(), "failure").otherwise("success").alias("final_state"),
    )
