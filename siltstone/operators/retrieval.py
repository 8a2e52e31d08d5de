"""Multi-route retrieval: routes, interleaving, provenance, ceilings, early stop; and query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as t
from siltstone.operators import ranking

MAX_CANDIDATES, PER_ROUTE = 100, 20
MODES = ("broad_lexical", "title_abstract", "semantic")
MAX_PLANNED, MAX_GENERATED, FIRST_DETERMINISTIC = 6, 3, 2


def routes(queries: DataFrame, limit: int = PER_ROUTE) -> DataFrame:
    """queries (idea_id, ord from 0, text): the first one asks in all modes, the others lexically.

    idea_id, route_ord, text, mode, limit; route_ord counts the first query's modes, then the others.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    mode = F.when(F.col("ord") == 0, F.array(*map(F.lit, MODES))).otherwise(F.array(F.lit(MODES[0])))
    rows = queries.select("idea_id", "ord", "text", F.posexplode(mode).alias("pos", "mode"))
    at = F.when(F.col("ord") == 0, F.col("pos")).otherwise(F.col("ord") + len(MODES) - 1)
    return rows.select("idea_id", at.cast("int").alias("route_ord"), "text", "mode", F.lit(limit).alias("limit"))


def route_scores(papers: DataFrame, routes: DataFrame, vectors: DataFrame | None = None, route_vectors: DataFrame | None = None) -> DataFrame:
    """idea_id, route_ord, id, score: each route asked in its mode. routes: as routes() leaves them.

    Broad lexical routes score by BM25 whatever shares a token; title and abstract routes only papers that hold all tokens of the query; semantic routes by
    cosine of vectors (id, vector) with the route's own (idea_id, route_ord, vector), which ask for nothing where there are none.
    """
    unknown = routes.where(~F.col("mode").isin(*MODES) | F.col("mode").isNull())
    if not unknown.isEmpty():
        raise ValueError("a route has an unknown mode")
    key = F.struct("idea_id", "route_ord")
    lexical = routes.where(F.col("mode") != "semantic").select(key.alias("query_id"), "text", "mode")
    texts = lexical.select(F.col("text").alias("query_id"), "text").distinct()
    scores = ranking.bm25(papers, texts).select(F.col("query_id").alias("text"), "id", F.col("lexical_raw_score").alias("score")).where("score > 0")
    hits = lexical.join(scores, "text")
    q = ranking.query_tokens(texts)
    found, _ = ranking.postings(ranking.tokenised(papers), q)
    whole = found.join(q, "token").groupBy(F.col("query_id").alias("text"), "id").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where("k = n").select("text", "id")
    scoped = hits.where("mode = 'title_abstract'").join(whole, ["text", "id"], "left_semi")
    out = hits.where("mode = 'broad_lexical'").unionByName(scoped).select("query_id.idea_id", "query_id.route_ord", "id", "score")
    if vectors is None or route_vectors is None:
        return out
    asked = routes.where("mode = 'semantic'").join(route_vectors, ["idea_id", "route_ord"]).select(key.alias("query_id"), "vector")
    near = ranking.semantic(vectors, asked).select("query_id.idea_id", "query_id.route_ord", "id", F.col("semantic_raw_score").alias("score"))
    return out.unionByName(near)


def rank_routes(hits: DataFrame, limit: int = PER_ROUTE, by: tuple[str, ...] = ("idea_id",)) -> DataFrame:
    """hits (by..., route_ord, id, score) with provider_rank from 1: score descending, then id; `limit` a route."""
    w = Window.partitionBy(*by, "route_ord").orderBy(F.desc("score"), "id")
    return hits.withColumn("provider_rank", F.row_number().over(w)).where(F.col("provider_rank") <= limit)


def interleave(ranked: DataFrame, ceiling: int = MAX_CANDIDATES, by: tuple[str, ...] = ("idea_id",)) -> DataFrame:
    """First-seen candidates in the order (rank, route): by..., id, ord from 1, and what routes found them.

    provenance: distinct (route_ord, provider_rank, score) in the order seen. At most `ceiling` a group.
    """
    if not 1 <= ceiling <= 500:
        raise ValueError("the ceiling must lie between 1 and 500")
    seen = F.struct("provider_rank", "route_ord")
    folded = ranked.groupBy(*by, "id").agg(
        F.min(seen).alias("first"),
        F.array_sort(F.collect_set(F.struct("provider_rank", "route_ord", "score"))).alias("provenance"),
    )
    w = Window.partitionBy(*by).orderBy("first", "id")
    placed = folded.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= ceiling)
    return placed.select(*by, "id", "ord", "provenance")


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def provenance_union(hits: DataFrame) -> DataFrame:
    """hits (paper_id, ord, query_text, provider, mode, provider_rank, ...): the first of each distinct route result."""
    keyed = hits.withColumns({"_q": t.collapse(t.casefold(F.col("query_text"))), "_p": t.casefold(F.col("provider"))})
    return first_seen(keyed, ["paper_id", "_q", "_p", "mode", "provider_rank"], ["ord"]).drop("_q", "_p")


def plan_queries(original: DataFrame, generated: DataFrame, limit: int = MAX_PLANNED) -> DataFrame:
    """original: idea_id, text. generated: idea_id, ord, text, strategy, source (deterministic or llm).

    The original first; then two deterministic, three generated by a model, and the remaining deterministic
    queries, distinct by folded text, each of two terms at least. idea_id, ord from 0, text, origins.
    """
    if not 1 <= limit <= MAX_PLANNED:
        raise ValueError(f"limit must lie between 1 and {MAX_PLANNED}")
    own = original.select(
        "idea_id", F.lit(-1).alias("ord"), t.collapse(F.col("text")).alias("text"), F.lit("original").alias("strategy"), F.lit("deterministic").alias("source")
    )
    order = F.when(F.col("strategy") == "original", 0).when(F.col("source") == "deterministic", 1).otherwise(2)
    words = F.filter(F.split("text", r"[^\p{L}\p{N}_+#.\-]+"), lambda w: (w != "") & ~F.lower(w).isin("and", "or"))
    rows = own.unionByName(generated.select("idea_id", "ord", "text", "strategy", "source")).withColumns(
        {"key": t.collapse(t.casefold(F.col("text"))), "grp": order, "terms": F.size(words)}
    )
    seen = F.struct("grp", "ord")
    first_det = F.min(F.when((F.col("grp") == 1) & (F.col("terms") >= 2), F.col("ord")))
    first_llm = F.min(F.when((F.col("grp") == 2) & (F.col("terms") >= 2), F.col("ord")))
    folded = rows.groupBy("idea_id", "key").agg(
        F.min_by("text", seen).alias("text"),
        F.array_sort(F.collect_list(F.struct("grp", "ord", "strategy", "source"))).alias("found"),
        F.min("grp").alias("least"),
        first_det.alias("det"),
        first_llm.alias("llm"),
    )
    by_det = F.row_number().over(Window.partitionBy("idea_id", F.col("det").isNull() | (F.col("least") == 0)).orderBy("det"))
    by_llm = F.row_number().over(Window.partitionBy("idea_id", F.col("llm").isNull() | (F.col("least") == 0)).orderBy("llm"))
    ranked = folded.withColumns({"rd": F.when(F.col("det").isNotNull(), by_det), "rl": F.when(F.col("llm").isNotNull(), by_llm)})
    tier = (
        F.when(F.col("least") == 0, F.struct(F.lit(0).alias("tier"), F.lit(0).alias("at")))
        .when(F.col("rd") <= FIRST_DETERMINISTIC, F.struct(F.lit(1).alias("tier"), F.col("rd").alias("at")))
        .when(F.col("rl") <= MAX_GENERATED, F.struct(F.lit(2).alias("tier"), F.col("rl").alias("at")))
        .when(F.col("rd").isNotNull(), F.struct(F.lit(3).alias("tier"), F.col("rd").alias("at")))
    )
    chosen = ranked.withColumn("place", tier).where(F.col("place").isNotNull())
    at = F.row_number().over(Window.partitionBy("idea_id").orderBy("place"))
    origins = F.array_distinct(F.transform("found", lambda x: F.struct(x["strategy"].alias("strategy"), x["source"].alias("source"))))
    out = chosen.withColumn("ord", (at - 1).cast("int")).where(F.col("ord") < limit)
    return out.select("idea_id", "ord", "text", origins.alias("origins"))


def adaptive_stop(rounds: DataFrame) -> DataFrame:
    """rounds: idea_id, ord from 0, text, ids (of the hits), failed. Marks the rounds that run, as `executed`.

    After two rounds at least, retrieval stops once two rounds in a row found nothing new (and did not fail) and
    every remaining query overlaps an executed one by 0.8. Windows over an idea's few queries.
    """
    w = Window.partitionBy("idea_id").orderBy("ord")
    before = F.array_distinct(F.flatten(F.collect_list("ids").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    fresh = F.size(F.array_except(F.transform("ids", lambda x: F.lower(x)), F.transform(before, lambda x: F.lower(x)))) > 0
    rows = rounds.withColumn("barren", ~fresh & ~F.col("failed"))
    streak = F.coalesce(F.lag("barren").over(w), F.lit(False)) & F.col("barren")
    texts = F.collect_list("text").over(w)
    later = F.collect_list("text").over(w.rowsBetween(1, Window.unboundedFollowing))
    covered = F.forall(later, lambda x: F.exists(texts, lambda y: t.overlap_coefficient(x, y) >= 0.8))
    rows = rows.withColumn("stops", streak & covered & (F.col("ord") >= 1) & (F.size(later) > 0))
    stopped = F.coalesce(F.max(F.col("stops").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("executed", stopped == 0).drop("barren", "stops")
