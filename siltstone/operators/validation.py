"""Papers as the engine takes them: normalisation of their fields, and what breaks the rules as rows.

papers: id, title and any of the other columns named below; others pass through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as t

# Single text fields, fields of distinct values, bounds of years, scores between 0 and 1, and names that a field may have.
TEXT_FIELDS = ("id", "title", "abstract", "doi", "openalex_id", "work_type", "source", "url")
LIST_FIELDS = ("authors", "openalex_aliases", "referenced_work_ids", "doi_aliases")
YEARS = (1000, 3000)
SCORES = ("lexical_score", "semantic_score", "constraint_score", "final_score")
CHOICES = {"ranking_mode": ("hybrid", "lexical_only")}


def distinct_by(values: Column, key) -> Column:
    """The first value of each key, in order; null and empty values go."""
    marked = F.transform(F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda v: F.struct(key(v).alias("k"), v.alias("v")))
    fresh = F.aggregate(
        marked, F.array().cast("array<struct<k:string,v:string>>"),
        lambda kept, x: F.when(F.exists(kept, lambda y: y["k"] == x["k"]), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return F.transform(fresh, lambda x: x["v"])


def _plain(field: str, value: Column) -> Column:
    """A value of a list as it is compared: white space collapsed, and no slash at the end but in names."""
    return t.collapse(value) if field == "authors" else F.rtrim(t.collapse(value), F.lit("/"))


def normalised_papers(papers: DataFrame) -> DataFrame:
    """papers with collapsed texts (empty ones null), and lists of distinct values whatever their case; identifiers and links lose a slash at their end."""
    out = papers
    for c in TEXT_FIELDS:
        if c in papers.columns:
            out = out.withColumn(c, F.nullif(t.collapse(F.col(c).cast("string")), F.lit("")) if dict(papers.dtypes)[c] == "string" else F.col(c))
    for c in LIST_FIELDS:
        if c in papers.columns:
            out = out.withColumn(c, distinct_by(F.transform(c, lambda v: _plain(c, v)), t.casefold))
    if "full_text_locations" in papers.columns:
        key = lambda v: F.rtrim(t.casefold(v["url"]), F.lit("/"))
        places = F.col("full_text_locations")
        numbered = F.transform(places, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
        keys = F.transform(places, key)
        first = F.filter(numbered, lambda x: F.array_position(keys, x["k"]) == x["i"] + 1)
        out = out.withColumn("full_text_locations", F.transform(first, lambda x: x["v"]))
    return out


def violations(papers: DataFrame) -> DataFrame:
    """id, field, reason: one row for each rule that a paper breaks. Papers that break none have no row; columns that are not there are not judged."""
    rules: list[tuple[str, str, Column]] = []
    has = papers.columns.__contains__
    for c in ("id", "title"):
        if has(c):
            rules.append((c, "empty", F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))))
    if has("publication_year"):
        rules.append(("publication_year", "out of bounds", ~F.col("publication_year").between(*YEARS)))
    if has("citation_count"):
        rules.append(("citation_count", "negative", F.col("citation_count") < 0))
    for c in filter(has, SCORES):
        rules.append((c, "out of bounds", ~F.col(c).between(0.0, 1.0) | F.isnan(c)))
    for c, names in CHOICES.items():
        if has(c):
            rules.append((c, "unknown name", ~F.col(c).isin(*names)))
    for c in filter(has, LIST_FIELDS):
        keys = F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: t.casefold(_plain(c, v)))
        rules.append((c, "repeated value", F.size(F.array_distinct(keys)) < F.size(keys)))
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("field"), F.lit(why).alias("reason"))) for c, why, bad in rules])
    rows = papers.select(F.col("id") if has("id") else F.lit(None).alias("id"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("x"))
    return rows.select("id", "x.field", "x.reason")


def table_violations(rows: DataFrame, required: tuple[str, ...] = (), unique: tuple[str, ...] = (), bounds: dict[str, tuple] | None = None, choices: dict[str, tuple] | None = None) -> DataFrame:
    """field, reason, value, n of any table's rows that lack a required value, repeat a unique key, leave bounds or use an unknown name."""
    checks = [rows.where(F.col(c).isNull()).groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(c).alias("field"), F.lit("missing").alias("reason"), F.lit(None).cast("string").alias("value"), "n") for c in required]
    if unique:
        key = F.concat_ws("|", *(F.col(c).cast("string") for c in unique))
        checks.append(rows.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(",".join(unique)).alias("field"), F.lit("repeated key").alias("reason"), "value", "n"))
    for c, (low, high) in (bounds or {}).items():
        checks.append(rows.where(~F.col(c).between(low, high)).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("field"), F.lit("out of bounds").alias("reason"), "value", "n"))
    for c, names in (choices or {}).items():
        checks.append(rows.where(~F.col(c).isin(*names)).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("field"), F.lit("unknown name").alias("reason"), "value", "n"))
    return reduce(DataFrame.unionByName, checks)
