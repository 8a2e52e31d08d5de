"""Results for readers: projections, coverage sums, distinct lists, renamed and withheld columns, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as t

WITHHELD = ("confidence", "idea_relevance", "retrieval_failures", "extraction_failures", "extraction_diagnostics", "provider_usage")
LEVELS = ("full_text", "abstract", "abstract_fallback", "metadata_only")
LEGACY = {"publication_year": "year", "openalex_id": "paper_id", "citation_count": "citations", "final_score": "score"}


def distinct_folded(values: Column) -> Column:
    """Non-blank values, white space collapsed, the first of each spelling without regard to case."""
    plain = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), t.collapse), lambda v: v.isNotNull() & (v != ""))
    return t.let(
        plain, lambda p: F.filter(p, lambda v, i: F.array_position(F.transform(p, t.casefold), t.casefold(v)) == i + 1)
    )


def normalise_payload(ideas: DataFrame, facets: list[str], keywords: int = 12) -> DataFrame:
    """A provider's decompositions with distinct facet values and at most `keywords` keywords.

    ideas: idea_id, original_text, given_text and facets; rows whose text the provider changed are dropped.
    """
    rows = ideas.where(F.col("given_text") == F.col("original_text"))
    cleaned = {c: distinct_folded(F.col(c)) for c in facets}
    if "keywords" in cleaned:
        cleaned["keywords"] = F.slice(cleaned["keywords"], 1, keywords)
    return rows.withColumns(cleaned).drop("given_text")


def normalise_generated(queries: DataFrame) -> DataFrame:
    """A provider's queries (idea_id, ord, text, strategy) of two terms at least: the first of each text, then of each strategy."""
    words = F.filter(F.split("text", r"[^\p{L}\p{N}_+#.\-]+"), lambda w: (w != "") & ~F.lower(w).isin("and", "or"))
    rows = queries.withColumn("text", t.collapse(F.col("text"))).where((F.col("text") != "") & (F.size(words) >= 2))
    # Sequential per idea: a text counts as seen only if its strategy was new when it came, and the other way round.
    packed = rows.groupBy("idea_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "strategy"))).alias("q"))
    none = F.array().cast("array<struct<ord:bigint,text:string,strategy:string>>")
    kept = F.aggregate(
        F.transform("q", lambda x: F.struct(x["ord"].cast("bigint").alias("ord"), x["text"].alias("text"), x["strategy"].alias("strategy"))),
        none,
        lambda a, x: F.when(F.exists(a, lambda y: (t.casefold(y["text"]) == t.casefold(x["text"])) | (y["strategy"] == x["strategy"])), a).otherwise(F.concat(a, F.array(x))),
    )
    return packed.select("idea_id", F.inline(kept))


def legacy(papers: DataFrame) -> DataFrame:
    return papers.select(*[F.col(c).alias(LEGACY.get(c, c)) for c in papers.columns])


def public(rows: DataFrame) -> DataFrame:
    """rows without columns that are not for readers."""
    return rows.drop(*WITHHELD)


def as_json(rows: DataFrame) -> DataFrame:
    return public(rows).select(F.to_json(F.struct(*public(rows).columns), {"ignoreNullFields": "false"}).alias("json"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """One row from coverage (final_evidence_level, final_state, full_text_attempted, full_text_status, truncated): successes by level,
    failures, whether all is accounted for, attempts and what became of them."""
    level = lambda x: F.count_if(F.col("final_evidence_level") == x)
    out = coverage.agg(
        F.count(F.lit(1)).alias("requested"), *[level(x).alias(f"{x}_successes") for x in LEVELS], F.count_if(F.col("final_state") == "failure").alias("final_failures"),
        F.count_if(F.col("full_text_attempted")).alias("full_text_attempts"), F.count_if(F.col("full_text_status") == "fetch_failed").alias("fetch_failures"),
        F.count_if(F.col("full_text_status") == "parse_failed").alias("parse_failures"), F.count_if(F.col("truncated")).alias("truncations"),
    )
    total = F.col("final_failures")
    for x in LEVELS:
        total = total + F.col(f"{x}_successes")
    return out.withColumns({"accounted": total, "partial": F.col("final_failures") > 0})


def performance(runs: DataFrame) -> DataFrame:
    """One row over runs (seconds, hits, requests, input_tokens, output_tokens, cost): latency, mean hit rate, sums; null where nothing is known."""
    rate = F.when(F.col("requests") > 0, F.col("hits") / F.col("requests")).otherwise(0.0)
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean_seconds"), F.median("seconds").alias("median_seconds"), F.min("seconds").alias("least_seconds"),
        F.max("seconds").alias("greatest_seconds"), F.avg(rate).alias("hit_rate"), F.sum("requests").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"),
    )


def stage_seconds(timings: DataFrame) -> DataFrame:
    """stage, seconds summed over runs. timings: run_id, stage, seconds."""
    return timings.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.countDistinct("run_id").alias("runs"))
