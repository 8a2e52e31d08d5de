"""Six retrieval variants over one parameterised plan, and the registered queries on ideas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import bounds, lexical, planning, ranking, retrieval
from siltstone.plans.views import load, papers
from siltstone.sources.staging import Staged

VARIANTS = ("original_only", "deterministic_expansion", "llm_expansion", "combined_expansion", "hybrid_retrieval", "hybrid_reranked")
OUT = "variant string, idea_id long, ord int, id long, available boolean, reason string"


def _lexical(planned: DataFrame, hits: DataFrame, ceiling: int) -> DataFrame:
    """planned: idea_id, route_ord, text; hits: text, id, score (of every distinct query text)."""
    return retrieval.interleave(retrieval.rank_routes(planned.join(hits, "text").select("idea_id", "route_ord", "id", "score")), ceiling)


def _near(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, semantic_raw_score of the vectors that may be among the k nearest; bounds compare rounded scores, so those that round alike come too."""
    made = bounds.gather(vectors)
    last = bounds.nearest(made, queries, k).groupBy("query_id").agg(F.min("score").alias("_s"))
    floors = queries.join(last, "query_id").select("query_id", "vector", (F.col("_s") - 10.0**-bounds.DIGITS).alias("floor"))
    return ranking.cosines(vectors, queries, Staged(bounds.within(made, floors).select("query_id", "id"), "near").df)


def variants(
    corpus: DataFrame, ideas: DataFrame, generated: DataFrame | None = None, semantic: DataFrame | None = None, ceiling: int = 50, vectors: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """variant, idea_id, ord, id, available, reason: what each variant retrieves for each idea.

    ideas: idea_id, text; generated: idea_id, ord, text of a model; semantic: idea_id, id, semantic_raw_score of all pairs, or instead of it vectors: those of
    the corpus (id, vector) and of ideas (query_id, vector), of which only cosines that matter become rows. A variant that lacks a dependency has one row without
    id that says so, never an empty result. Each distinct query text is scored for all variants at once; routes take its first few hits, so no more become rows.
    """
    original = ideas.select("idea_id", "text")
    own = planning.generate_queries(planning.decompose_ideas(ideas)).where("source = 'deterministic' and strategy != 'original'")
    none = own.limit(0)
    model = none if generated is None else generated.select("idea_id", "ord", "text", F.lit("llm").alias("strategy"), F.lit("llm").alias("source"))
    plan = lambda *sources: retrieval.plan_queries(original, reduce(DataFrame.unionByName, sources)).select("idea_id", F.col("ord").alias("route_ord"), "text")
    combined = Staged(plan(own, model), "planned").df
    texts = reduce(DataFrame.unionByName, [combined.select("text"), plan(own).select("text"), plan(model).select("text") if generated is not None else combined.select("text")]).distinct()
    scores = lexical.scores(corpus, texts.select(F.col("text").alias("query_id"), "text"))
    hits = Staged(scores.best(retrieval.PER_ROUTE)[0].select(F.col("query_id").alias("text"), "id", F.col("lexical_raw_score").alias("score")), "hits").df
    first = combined.where("route_ord = 0")
    done = {"original_only": _lexical(first, hits, ceiling), "deterministic_expansion": _lexical(plan(own), hits, ceiling)}
    lacking = {}
    if generated is None:
        lacking |= dict.fromkeys(("llm_expansion", "combined_expansion"), "query generator")
    else:
        done |= {"llm_expansion": _lexical(plan(model), hits, ceiling), "combined_expansion": _lexical(combined, hits, ceiling)}
    if semantic is None and vectors is None:
        lacking |= dict.fromkeys(("hybrid_retrieval", "hybrid_reranked"), "vectors")
    else:
        routes = combined.join(hits, "text").select("idea_id", F.col("route_ord").alias("route_ord"), "id", "score")
        near = semantic if vectors is None else _near(*vectors, retrieval.PER_ROUTE).withColumnRenamed("query_id", "idea_id")
        near = near.select("idea_id", F.lit(-1).alias("route_ord"), "id", F.col("semantic_raw_score").alias("score"))
        pool = Staged(retrieval.interleave(retrieval.rank_routes(routes.unionByName(near)), ceiling), "pool").df
        done["hybrid_retrieval"] = pool
        own_text = pool.select("idea_id", "id").join(first.select("idea_id", "text"), "idea_id")
        raw = own_text.join(scores.of(own_text.select(F.col("text").alias("query_id"), "id").distinct()).withColumnRenamed("query_id", "text"), ["text", "id"])
        raw = raw.select("idea_id", "id", "lexical_raw_score")
        cosine = semantic if vectors is None else ranking.cosines(*vectors, pool.select(F.col("idea_id").alias("query_id"), "id")).withColumnRenamed("query_id", "idea_id")
        both = pool.select("idea_id", "id").join(raw, ["idea_id", "id"], "left").join(cosine, ["idea_id", "id"], "left").withColumn("query_id", F.col("idea_id"))
        ranked = ranking.fuse(both.withColumn("lexical_raw_score", F.coalesce("lexical_raw_score", F.lit(0.0))))
        done["hybrid_reranked"] = ranking.top_k(ranked, [F.desc("final_score"), F.asc("id")], ceiling, "idea_id", "ord").select("idea_id", "ord", "id")
    spark = corpus.sparkSession
    rows = [df.select(F.lit(v).alias("variant"), "idea_id", F.col("ord").cast("int").alias("ord"), F.col("id").cast("long").alias("id"), F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason")) for v, df in done.items()]
    rows.append(spark.createDataFrame([(v, None, None, None, False, f"missing: {why}") for v, why in lacking.items()], OUT))
    return reduce(DataFrame.unionByName, rows)


def ablation_variants(spark, sf_dir):
    """Passages as ideas; the vector of a passage's number stands for it; no generated queries, so two variants are unavailable."""
    ideas = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idea_id"), "text")
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = ideas.join(e, F.col("idea_id") == F.col("id")).select(F.col("idea_id").alias("query_id"), "vector")
    return variants(papers(spark, sf_dir), ideas, vectors=(e, q))


def _turns(spark, sf_dir) -> DataFrame:
    """Every turn of every conversation as an idea."""
    return load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).cast("long").alias("idea_id"), "text")


def decomposed_ideas(spark, sf_dir):
    """Turns of conversations as ideas: facets and keywords."""
    return planning.decompose_ideas(_turns(spark, sf_dir)).drop("synonyms")


def generated_queries(spark, sf_dir):
    return planning.generate_queries(planning.decompose_ideas(_turns(spark, sf_dir)))


QUERIES = {"ablation_variants": ablation_variants, "decomposed_ideas": decomposed_ideas, "generated_queries": generated_queries}
SQL: dict[str, str] = {}
