"""Registered queries on ranking, retrieval, graphs and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.functions import vectors as v
from siltstone.operators import bounds, graph, lexical, ranking, retrieval
from siltstone.plans.views import PAPERS, fold_sql, load, papers, queries, tokens_sql
from siltstone.sources.staging import Staged

BM25 = f"""
{PAPERS}, q0 AS (SELECT item_id AS query_id, {tokens_sql('text')} AS toks FROM benchmark),
q AS (SELECT query_id, len(list_distinct(toks)) AS n, array_to_string(toks, ' ') AS phrase, unnest(list_distinct(toks)) AS token FROM q0),
doc AS (SELECT id, {tokens_sql('title')} AS tt, {tokens_sql('abstract')} AS ta FROM papers),
stats AS (SELECT count(*) AS n_docs, avg(3 * len(tt) + len(ta)) AS avg_len FROM doc),
word AS (
  SELECT id, token, sum(w) AS tf, max(t) AS in_title, max(1 - t) AS in_abstract FROM (
    SELECT id, unnest(tt) AS token, 3 AS w, 1 AS t FROM doc UNION ALL SELECT id, unnest(ta), 1, 0 FROM doc) GROUP BY id, token
), df AS (SELECT token, count(*) AS df FROM word GROUP BY token),
scored AS (
  SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (3 * len(tt) + len(ta)) / avg_len)))
         + 1.5 * sum(in_title) / max(n) + 0.5 * sum(in_abstract) / max(n) AS s
  FROM word JOIN q USING (token) JOIN df USING (token) JOIN doc USING (id), stats GROUP BY query_id, id
), phrases AS (
  SELECT query_id, id, CASE WHEN contains(array_to_string(tt, ' '), phrase) THEN 2.0 ELSE 0.75 END AS bonus
  FROM (SELECT query_id, array_to_string(toks, ' ') AS phrase FROM q0 WHERE len(toks) > 0) p, doc
  WHERE contains(array_to_string(tt, ' '), phrase) OR contains(array_to_string(ta, ' '), phrase)
), lexical AS (
  SELECT query_id, id, coalesce(s, 0) + coalesce(bonus, 0) AS raw FROM scored FULL JOIN phrases USING (query_id, id)
), scaled AS (
  SELECT query_id, id, raw, CASE WHEN count(*) OVER w < n_docs THEN least(0, min(raw) OVER w) ELSE min(raw) OVER w END AS lo, max(raw) OVER w AS hi
  FROM lexical, stats WINDOW w AS (PARTITION BY query_id)
)"""


def bm25_topk(spark, sf_dir):
    """The 20 best documents of each benchmark passage by BM25, scaled per passage."""
    p = papers(spark, sf_dir)
    best, spread = lexical.scores(p, queries(spark, sf_dir)).best(20, 6)
    raw = F.col("lexical_raw_score")
    top = ranking.top_k(best, [F.desc(F.round(raw, 6)), F.asc("id")], 20).join(F.broadcast(spread), "query_id").join(F.broadcast(p.agg(F.count(F.lit(1)).alias("n_docs"))))
    low = F.when(F.col("_n") < F.col("n_docs"), F.least(F.lit(0.0), F.col("_lo"))).otherwise(F.col("_lo"))
    return top.select("query_id", "rank", F.col("id").alias("doc_id"), F.round(raw, 6).alias("raw"), F.round(v.scaled(raw, low, F.col("_hi")), 6).alias("score"))


BM25_TOPK = f"""WITH {BM25}
SELECT query_id, CAST(rank AS INTEGER) AS rank, id AS doc_id, round(raw, 6) AS raw, round((raw - lo) / (hi - lo), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, id) AS rank FROM scaled) WHERE rank <= 20"""


def cosine_scores(spark, sf_dir):
    """Cosine of every vector with the first vector of each label."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.groupBy("label").agg(F.min_by("vector", "id").alias("vector")).select(F.col("label").alias("query_id"), "vector")
    return ranking.semantic(e, q).select("query_id", "id", F.round("semantic_raw_score", 5).alias("score"))


COSINE = """WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)
SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 5) AS score FROM embeddings, q"""


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def cosine_topk(spark, sf_dir):
    """The 20 vectors nearest to that of each passage (vec_id = item_id), through blocks that bounds rule out."""
    e = _vectors(spark, sf_dir)
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    found = bounds.nearest(bounds.gather(e), q.join(e, F.col("query_id") == F.col("id")).select("query_id", "vector"), 20)
    return found.select("query_id", "rank", "id", "score")


COSINE_TOPK = """WITH s AS (SELECT item_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 6) + 0.0 AS score
  FROM embeddings a JOIN benchmark ON a.vec_id = item_id, embeddings b)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s QUALIFY rank <= 20"""


def hybrid_fusion(spark, sf_dir):
    """Documents that have a vector (doc_id = vec_id) ranked for each passage by words and vector together.

    Documents without a word of the passage rank among themselves by vector alone, so the first by vector and those with a word are all that can come first.
    """
    p = papers(spark, sf_dir)
    e = Staged(_vectors(spark, sf_dir).join(p.select("id"), "id", "left_semi"), "vectors").df
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    qv = Staged(q.join(_vectors(spark, sf_dir), F.col("query_id") == F.col("id")).select("query_id", "vector"), "query-vectors").df
    lex = lexical.scores(p, queries(spark, sf_dir))
    top = ranking.hybrid_topk(e, qv, lex, 10)
    return top.select("query_id", "rank", "id", F.round("final_score", 5).alias("final_score"))


HYBRID = f"""WITH {BM25},
sem AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS s
  FROM embeddings a JOIN benchmark ON a.vec_id = item_id, embeddings b WHERE b.vec_id IN (SELECT id FROM papers)),
both_ AS (SELECT query_id, id, s, coalesce(raw, 0) AS raw FROM sem LEFT JOIN lexical USING (query_id, id)),
n AS (SELECT query_id, id,
  CASE WHEN max(raw) OVER w = min(raw) OVER w THEN CASE WHEN max(raw) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS l,
  (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS m FROM both_ WINDOW w AS (PARTITION BY query_id))
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(f, 5) AS final_score FROM (
  SELECT query_id, id, 0.4 * l + 0.6 * m AS f, row_number() OVER (PARTITION BY query_id ORDER BY round(0.4 * l + 0.6 * m, 6) DESC, id) AS rank FROM n) WHERE rank <= 10"""


def constraint_boost(spark, sf_dir):
    """Lexical ranking of vectors' neighbours raised by one constraint per passage: closeness to the next passage's vector.

    A constraint raises a score by its weight at most, so only vectors whose own score comes that near to the tenth best can come first.
    """
    e = Staged(_vectors(spark, sf_dir), "vectors").df
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    own = Staged(items.join(e, F.col("query_id") == F.col("id")).select("query_id", "vector"), "own").df
    nxt = Staged(items.join(e, F.col("query_id") + 1 == F.col("id")).select("query_id", "vector"), "next").df
    made = bounds.gather(e)
    reach = ranking.boostable(made, e, own, 10)
    base = reach.select("query_id", "id", "final_score")
    con = ranking.scaled_cosines(made, e, nxt, base.select("query_id", "id")).select("query_id", "id", F.lit(0).alias("constraint_id"), "score")
    out = ranking.boost(base, con).select("query_id", "id", F.round("constraint_score", 5).alias("constraint_score"), F.round("final_score", 5).alias("final_score"))
    return ranking.top_k(out, [F.desc("final_score"), F.asc("id")], 10).select("query_id", "rank", "id", "constraint_score", "final_score")


BOOST = """WITH c AS (
  SELECT item_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS s,
         list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) AS z
  FROM benchmark JOIN embeddings a ON a.vec_id = item_id LEFT JOIN embeddings x ON x.vec_id = item_id + 1, embeddings b),
n AS (SELECT query_id, id, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS l, (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) AS k FROM c WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(k, 5) AS constraint_score, round(least(1.0, l * (1 + 0.15 * coalesce(k, 0))), 5) AS final_score FROM n)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, constraint_score, final_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM f) WHERE rank <= 10"""


def route_interleave(spark, sf_dir):
    """Order lines as hits: an order's line numbers are routes, parts are candidates, the price their score."""
    line = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("idea_id"), F.col("l_linenumber").alias("route_ord"), F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("score")
    )
    ranked = retrieval.rank_routes(line.groupBy("idea_id", "route_ord", "id").agg(F.max("score").alias("score")))
    return retrieval.interleave(ranked, 50).select("idea_id", "ord", "id", F.size("provenance").alias("n_routes"))


INTERLEAVE = """WITH h AS (SELECT l_orderkey % 100 AS idea_id, l_linenumber AS route_ord, l_partkey AS id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY idea_id, route_ord ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 20),
f AS (SELECT idea_id, id, min(struct_pack(a := rank, b := route_ord)) AS first, count(*) AS n_routes FROM r GROUP BY idea_id, id)
SELECT idea_id, CAST(row_number() OVER (PARTITION BY idea_id ORDER BY first, id) AS INTEGER) AS ord, id, CAST(n_routes AS INTEGER) AS n_routes FROM f QUALIFY ord <= 50"""


def plan_quota(spark, sf_dir):
    """Conversations as ideas: the first turn is the original, users' turns deterministic, the others generated queries."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("idea_id"), F.col("turn").alias("ord"), "text", "role")
    first = retrieval.first_seen(c, ["idea_id"], ["ord", "text"])
    rest = c.withColumns({"strategy": F.lit("turn"), "source": F.when(F.col("role") == "user", "deterministic").otherwise("llm")})
    rest = rest.groupBy("idea_id", "ord", "source", "strategy").agg(F.min("text").alias("text"))
    return retrieval.plan_queries(first.select("idea_id", "text"), rest).select("idea_id", "ord", "text", F.size("origins").alias("n_origins"))


PLAN = f"""WITH c AS (SELECT conv_id AS idea_id, turn AS ord, text, role FROM conversations),
o AS (SELECT idea_id, -1 AS ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, 'original' AS strategy, 'deterministic' AS source, 0 AS grp
  FROM c QUALIFY row_number() OVER (PARTITION BY idea_id ORDER BY ord, text) = 1),
g AS (SELECT idea_id, ord, min(text) AS text, 'turn' AS strategy, CASE WHEN role = 'user' THEN 'deterministic' ELSE 'llm' END AS source,
  CASE WHEN role = 'user' THEN 1 ELSE 2 END AS grp FROM c GROUP BY ALL),
a AS (SELECT *, trim(regexp_replace({fold_sql('text')}, '\\s+', ' ', 'g')) AS key,
  len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_+#.\\-]+'), lambda w: lower(w) NOT IN ('and', 'or'))) >= 2 AS fine FROM (SELECT * FROM o UNION ALL SELECT * FROM g)),
f AS (SELECT idea_id, key, arg_min(text, struct_pack(a := grp, b := ord)) AS text, min(grp) AS least, min(ord) FILTER (grp = 1 AND fine) AS det,
  min(ord) FILTER (grp = 2 AND fine) AS llm, len(list_distinct(list(struct_pack(a := strategy, b := source)))) AS n_origins FROM a GROUP BY idea_id, key),
r AS (SELECT *, CASE WHEN det IS NOT NULL THEN row_number() OVER (PARTITION BY idea_id, det IS NULL OR least = 0 ORDER BY det) END AS rd,
  CASE WHEN llm IS NOT NULL THEN row_number() OVER (PARTITION BY idea_id, llm IS NULL OR least = 0 ORDER BY llm) END AS rl FROM f),
p AS (SELECT *, CASE WHEN least = 0 THEN 0 WHEN rd <= 2 THEN 10 + rd WHEN rl <= 3 THEN 100 + rl WHEN rd IS NOT NULL THEN 1000 + rd END AS place FROM r)
SELECT idea_id, CAST(row_number() OVER (PARTITION BY idea_id ORDER BY place) - 1 AS INTEGER) AS ord, text, CAST(n_origins AS INTEGER) AS n_origins
FROM p WHERE place IS NOT NULL QUALIFY ord < 6"""


def _cited(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    url = lambda c: F.concat(F.lit("https://openalex.org/W"), (c + 1).cast("string"))
    nodes = d.withColumn("aliases", F.array(url(F.col("paper_id"))))
    refs = d.join(F.broadcast(n)).select(
        "paper_id", F.explode(F.array(url(F.floor(F.col("paper_id") / 2)), url((F.col("paper_id") * 7 + 3) % F.floor(F.col("n") * 6 / 5)))).alias("reference")
    )
    resolved = graph.resolve_references(nodes, refs)
    return nodes, resolved, graph.edges(resolved)


def citation_degrees(spark, sf_dir):
    nodes, resolved, edge = _cited(spark, sf_dir)
    return graph.degrees(nodes, edge, resolved)


CITED = """d AS (SELECT doc_id AS paper_id FROM documents), n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT DISTINCT paper_id, ref FROM (SELECT paper_id, paper_id // 2 AS ref FROM d UNION ALL SELECT paper_id, (paper_id * 7 + 3) % (n * 6 // 5) FROM d, n) WHERE ref <> paper_id),
e AS (SELECT paper_id AS u, ref AS v FROM r WHERE ref IN (SELECT paper_id FROM d))"""

DEGREES = f"""WITH {CITED}, i AS (SELECT v AS paper_id, count(*) AS c FROM e GROUP BY v), o AS (SELECT u AS paper_id, count(*) AS c FROM e GROUP BY u),
x AS (SELECT paper_id, count(*) AS c FROM r WHERE ref NOT IN (SELECT paper_id FROM d) GROUP BY paper_id)
SELECT paper_id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(x.c, 0) AS external_reference_count,
       coalesce(i.c, 0) + coalesce(o.c, 0) = 0 AS isolated FROM d LEFT JOIN i USING (paper_id) LEFT JOIN o USING (paper_id) LEFT JOIN x USING (paper_id)"""


def citation_components(spark, sf_dir):
    """Components over references to later papers, so that there are many of them."""
    nodes, _, edge = _cited(spark, sf_dir)
    return graph.components(nodes, edge.where("cited_paper_id > citing_paper_id"))


COMPONENTS = f"""WITH RECURSIVE {CITED}, k AS (SELECT u, v FROM e WHERE v > u), s AS (SELECT u, v FROM k UNION SELECT v, u FROM k),
reach(u, v) AS (SELECT paper_id, paper_id FROM d UNION SELECT reach.u, s.v FROM reach JOIN s ON reach.v = s.u)
SELECT u AS paper_id, min(v) AS component_id FROM reach GROUP BY u"""


def citation_summary(spark, sf_dir):
    nodes, resolved, edge = _cited(spark, sf_dir)
    out = graph.summary(graph.degrees(nodes, edge, resolved), edge, graph.components(nodes, edge))
    return out


SUMMARY = f"""WITH {CITED}, touched AS (SELECT u AS p FROM e UNION SELECT v FROM e)
SELECT (SELECT count(*) FROM d) AS node_count, (SELECT count(*) FROM d WHERE paper_id NOT IN (SELECT p FROM touched)) AS isolated_node_count,
  (SELECT count(*) FROM r WHERE ref NOT IN (SELECT paper_id FROM d)) AS external_reference_count, (SELECT count(*) FROM e) AS edge_count, CAST(1 AS BIGINT) AS component_count"""


def query_overlap(spark, sf_dir):
    """How much each passage overlaps the next one: shared terms over the smaller set of terms."""
    b = load(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", F.round(t.overlap_coefficient(F.col("text"), F.col("other")), 6).alias("overlap"))


OVERLAP = f"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all({fold_sql('text')}, '[a-z0-9]+')) AS w FROM benchmark)
SELECT a.item_id, round(CASE WHEN least(len(a.w), len(b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) ELSE 0.0 END, 6) AS overlap FROM t a JOIN t b ON b.item_id = a.item_id + 1"""

QUERIES = {
    "bm25_topk": bm25_topk, "cosine_scores": cosine_scores, "cosine_topk": cosine_topk, "hybrid_fusion": hybrid_fusion, "constraint_boost": constraint_boost,
    "route_interleave": route_interleave, "plan_quota": plan_quota, "citation_degrees": citation_degrees,
    "citation_components": citation_components, "citation_summary": citation_summary, "query_overlap": query_overlap,
}
SQL = {
    "bm25_topk": BM25_TOPK, "cosine_scores": COSINE, "cosine_topk": COSINE_TOPK, "hybrid_fusion": HYBRID, "constraint_boost": BOOST, "route_interleave": INTERLEAVE,
    "plan_quota": PLAN, "citation_degrees": DEGREES, "citation_components": COMPONENTS, "citation_summary": SUMMARY, "query_overlap": OVERLAP,
}
