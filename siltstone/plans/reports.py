"""Registered queries on queues, reports, records, graphs in order and routes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import graph, landscape, operations, ranking, resolution, retrieval, validation
from siltstone.plans.views import FEATURES, PAPERS, feature_papers, features, load, order_sets, papers, rows_of
from siltstone.sources.staging import Staged


def _jobs(spark, sf_dir) -> DataFrame:
    """Orders as jobs: customers own them, the status says how far they are, the priority is their queue."""
    state = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "pending").otherwise("completed")
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("queue"), state.alias("status"), F.col("o_orderdate").alias("created_at"))


JOBS = """j AS (SELECT o_orderkey AS job_id, o_custkey AS owner_id, o_orderpriority AS queue, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'completed' END AS status FROM orders)"""


def active_jobs(spark, sf_dir):
    """Jobs of each owner that wait or run; owners whose jobs are all done have 0."""
    return operations.active_counts(_jobs(spark, sf_dir), "owner_id")


ACTIVE = f"WITH {JOBS} SELECT owner_id, count(*) FILTER (status IN ('pending', 'running')) AS active FROM j GROUP BY owner_id"


def pending_jobs(spark, sf_dir):
    """The first fifty waiting jobs of each queue, oldest first."""
    return operations.pending(_jobs(spark, sf_dir), 50, ["queue"]).select("queue", "place", "job_id", "created_at")


PENDING = f"""WITH {JOBS} SELECT queue, CAST(row_number() OVER (PARTITION BY queue ORDER BY created_at, job_id) AS INTEGER) AS place, job_id, created_at FROM j WHERE status = 'pending' QUALIFY place <= 50"""


def landscape_report(spark, sf_dir):
    """Ten commonest values of each dimension; ten pairs that two papers or more hold, and ten that one does."""
    sets, p = order_sets(spark, sf_dir), feature_papers(spark, sf_dir)
    out = landscape.report(landscape.frequencies(rows_of(sets), p, once=True), landscape.combos(sets, p, 2))
    return out.select("section", "rank", "name", "count")


_PLACE = "list_position(['problem','population_or_setting','method','method_family','dataset','dataset_type','baseline','constraint'], dimension)"
REPORT = f"""WITH {FEATURES}, v AS (SELECT dimension AS section, value AS name, count(*) AS count FROM features GROUP BY ALL),
f AS (SELECT paper_id, dimension || '=' || value AS name, {_PLACE} AS i, dimension, value FROM features JOIN fpapers USING (paper_id) WHERE study_type IN ('empirical', 'methodological') AND {_PLACE} IS NOT NULL),
c AS (SELECT a.name || ' & ' || b.name AS name, count(*) AS count FROM f a JOIN f b ON a.paper_id = b.paper_id AND a.i < b.i GROUP BY 1),
u AS (SELECT section, name, count FROM v UNION ALL SELECT CASE WHEN count >= 2 THEN 'repeated combinations' ELSE 'single combinations' END, name, count FROM c)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY count DESC, name) AS INTEGER) AS rank, name, count FROM u QUALIFY rank <= 10"""


def record_violations(spark, sf_dir):
    """Parts as papers: names repeat the maker, sizes are years, prices scores; what breaks a rule is a row."""
    p = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.col("p_name")).alias("title"), (F.col("p_size") * 100).alias("publication_year"),
        (F.col("p_size") - 3).alias("citation_count"), F.array(F.upper("p_brand"), F.lower("p_brand"), F.lit("x")).alias("authors"), (F.col("p_size") / 40).alias("final_score"),
        F.when(F.col("p_size") % 2 == 0, "hybrid").when(F.col("p_size") % 5 == 0, F.lit("other")).alias("ranking_mode"),
    )
    return validation.violations(p)


VIOLATIONS = """SELECT p_partkey AS id, 'title' AS field, 'empty' AS reason FROM part WHERE p_partkey % 11 = 0
UNION ALL SELECT p_partkey, 'publication_year', 'out of bounds' FROM part WHERE p_size * 100 < 1000 OR p_size * 100 > 3000
UNION ALL SELECT p_partkey, 'citation_count', 'negative' FROM part WHERE p_size < 3
UNION ALL SELECT p_partkey, 'final_score', 'out of bounds' FROM part WHERE p_size > 40
UNION ALL SELECT p_partkey, 'ranking_mode', 'unknown name' FROM part WHERE p_size % 2 <> 0 AND p_size % 5 = 0
UNION ALL SELECT p_partkey, 'authors', 'repeated value' FROM part"""


def asked_routes(spark, sf_dir):
    """Conversations as ideas, their turns as queries: the first asks in three modes, the others by words."""
    c = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("idea_id"), F.col("turn").alias("ord")).agg(F.min("text").alias("text"))
    return retrieval.routes(c, 25)


ROUTES = """WITH c AS (SELECT conv_id AS idea_id, turn AS ord, min(text) AS text FROM conversations GROUP BY ALL),
m(mode, pos) AS (VALUES ('broad_lexical', 0), ('title_abstract', 1), ('semantic', 2))
SELECT idea_id, CAST(CASE WHEN ord = 0 THEN pos ELSE ord + 2 END AS INTEGER) AS route_ord, text, mode, 25 AS "limit" FROM c JOIN m ON ord = 0 OR pos = 0"""


def richest_evidence(spark, sf_dir):
    """Order lines as evidence on parts: the fullest line of each part, then the surest, then the first."""
    e = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("n_values"), F.max("l_discount").alias("confidence"))
    e = e.select(F.concat(F.lit("P"), "l_partkey").alias("canonical_id"), "n_values", "confidence", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return landscape.richest_evidence(e).select("canonical_id", "ord", "n_values", "confidence")


RICHEST = """WITH e AS (SELECT 'P' || l_partkey AS canonical_id, max(l_quantity) AS n_values, max(l_discount) AS confidence, l_orderkey * 10 + l_linenumber AS ord FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey)
SELECT canonical_id, ord, n_values, confidence FROM e QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY n_values DESC, confidence DESC, ord) = 1"""


def canonical_evidence(spark, sf_dir):
    """Events as evidence of users; documents whose text recurs are one work, and a user number maps to a work if exactly one has it."""
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("d"), "user_id").alias("paper_id"), "event_id")
    d = load(spark, sf_dir, "documents")
    same = d.select(F.concat(F.lit("D"), F.col("doc_id") % 700).alias("paper_id"), F.concat(F.lit("w"), F.floor(F.col("doc_id") % 1400 / 10).cast("long")).alias("canonical_id"))
    return landscape.canonical_evidence(e, same).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))


CANONICAL = """WITH s AS (SELECT 'd' || doc_id % 700 AS k, 'w' || (doc_id % 1400) // 10 AS c FROM documents),
o AS (SELECT k, max(c) AS c FROM s GROUP BY k HAVING count(DISTINCT c) = 1)
SELECT coalesce(c, 'd' || user_id) AS canonical_id, count(*) AS n FROM events LEFT JOIN o ON k = 'd' || user_id GROUP BY 1"""


def final_ranking(spark, sf_dir):
    """Documents in the order of results: ties of coarse scores go on to title, year and identifier; the first hundred of each source."""
    p = papers(spark, sf_dir)
    coarse = lambda k: ((F.col("id") * k) % 7 / 10).alias
    rows = p.select(
        F.col("id"), "title", F.when(F.col("id") % 4 != 0, F.col("publication_year")).alias("publication_year"), "source", coarse(3)("final_score"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 5) / 10).alias("constraint_score"), F.when(F.col("id") % 2 == 0, (F.col("id") % 2) / 10).alias("semantic_score"), ((F.col("id") % 3) / 10).alias("lexical_score"),
    )
    return ranking.top_k(rows, ranking.final_order(), 100, by="source").select("source", "rank", "id")


FINAL = f"""WITH {PAPERS}, r AS (SELECT id, source, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS title, CASE WHEN id % 4 <> 0 THEN publication_year ELSE 0 END AS y,
  id * 3 % 7 AS f, CASE WHEN id % 3 = 0 THEN id % 5 ELSE -10 END AS c, CASE WHEN id % 2 = 0 THEN 0 ELSE -10 END AS s, id % 3 AS l FROM papers)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY f DESC, c DESC, s DESC, l DESC, title, y, CAST(id AS VARCHAR)) AS INTEGER) AS rank, id FROM r QUALIFY rank <= 100"""


def ordered_graph(spark, sf_dir):
    """The graph among the first 500 documents, its edges in order of identifiers."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"))
    url = lambda c: F.concat(F.lit("https://openalex.org/W"), (c + 1).cast("string"))
    refs = d.select("paper_id", F.explode(F.array(url(F.floor(F.col("paper_id") / 3)), url(F.col("paper_id") * 2 + 1))).alias("reference"))
    _, edges = graph.bounded(d.withColumn("aliases", F.array(url(F.col("paper_id")))), refs)
    return edges.select("ord", "citing_paper_id", "cited_paper_id")


ORDERED = """WITH d AS (SELECT doc_id AS p FROM documents ORDER BY doc_id LIMIT 500), r AS (SELECT DISTINCT p, ref FROM (SELECT p, p // 3 AS ref FROM d UNION ALL SELECT p, 2 * p + 1 FROM d) WHERE ref <> p AND ref IN (SELECT p FROM d))
SELECT CAST(row_number() OVER (ORDER BY CAST(p AS VARCHAR), CAST(ref AS VARCHAR)) - 1 AS INTEGER) AS ord, p AS citing_paper_id, ref AS cited_paper_id FROM r"""


def richest_records(spark, sf_dir):
    """The record that leads each work: copies of a text are its records, which differ in kind, authors and links."""
    p = papers(spark, sf_dir)
    kind = F.when(F.col("id") % 3 == 0, "preprint").when(F.col("id") % 3 == 1, "article").otherwise("other")
    rows = p.select(
        F.sha1(F.concat_ws("\n", "title", "abstract")).alias("work"), F.col("id").alias("ord"), "title", "abstract", kind.alias("work_type"), F.when(F.col("id") % 2 == 0, "10.1/x").alias("doi"),
        F.when(F.col("id") % 5 == 0, F.array(F.lit("u"))).alias("full_text_locations"), F.array_repeat(F.lit("a"), (F.col("id") % 4).cast("int")).alias("authors"),
        F.lit(None).cast("date").alias("publication_date"), "source", F.lit(None).cast("string").alias("url"),
    )
    return ranking.top_k(rows, resolution.richness(), 1, by="work").select("work", "ord")


LEADS = f"""WITH {PAPERS}, r AS (SELECT sha1(title || chr(10) || abstract) AS work, id AS ord, CASE id % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS kind, CAST(id % 2 = 0 AS INTEGER) AS doi,
  CAST(id % 5 = 0 AS INTEGER) AS places, id % 4 AS authors, CAST(coalesce(source, '') <> '' AS INTEGER) AS src FROM papers)
SELECT work, ord FROM r QUALIFY row_number() OVER (PARTITION BY work ORDER BY kind DESC, doi DESC, places DESC, authors DESC, src DESC, ord) = 1"""

QUERIES = {g.__name__: g for g in (active_jobs, pending_jobs, landscape_report, record_violations, asked_routes, richest_evidence, canonical_evidence, final_ranking, ordered_graph, richest_records)}
SQL = {
    "active_jobs": ACTIVE, "pending_jobs": PENDING, "landscape_report": REPORT, "record_violations": VIOLATIONS, "asked_routes": ROUTES, "richest_evidence": RICHEST, "canonical_evidence": CANONICAL,
    "final_ranking": FINAL, "ordered_graph": ORDERED, "richest_records": LEADS,
}
