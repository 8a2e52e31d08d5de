"""Registered queries on texts, evidence, resolution, gaps and verification, with their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import features as f
from siltstone.functions import text as t
from siltstone.operators import documents, evaluation, evidence, gaps, landscape, resolution, verification
from siltstone.plans.views import FEATURES, LINES, PAPERS, feature_papers, features, fold_sql, line_features, load, papers, rows_of, staged_lines, staged_sets
from siltstone.sources import caches, works
from siltstone.sources.staging import Staged


def _key_sql(c: str) -> str:
    """The evidence key in DuckDB."""
    plain = f"regexp_replace(regexp_replace({fold_sql(c)}, '[-_]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


def evidence_support(spark, sf_dir):
    """Quotations of five words against their declared source: of the own document, or (every third) of another's."""
    p = papers(spark, sf_dir)
    quote = lambda c: F.array_join(F.slice(F.split(c, " "), 2, 5), " ")
    own = p.select(F.col("id").alias("paper_id"), F.when(F.col("id") % 2 == 0, quote(F.col("title"))).otherwise(F.lower(quote(F.col("abstract")))).alias("q"))
    shifted = own.select(F.col("paper_id") + F.when(F.col("paper_id") % 3 == 0, 2).otherwise(0), "q").toDF("paper_id", "q")
    claims = shifted.where("q != ''").select(
        "paper_id", F.lit("main_findings").alias("field"), F.col("q").alias("evidence_text"), F.when(F.col("paper_id") % 2 == 0, "title").otherwise("abstract").alias("source"),
        *[F.lit(None).cast("string").alias(c) for c in ("section_id", "section_heading", "section_type")],
    )
    meta = p.select(F.col("id").alias("paper_id"), "title", "abstract")
    return evidence.with_failure(claims, meta).select("paper_id", "source", F.sha1("evidence_text").alias("quote"), "failure")


SUPPORT = f"""WITH {PAPERS}, own AS (SELECT id, CASE WHEN id % 2 = 0 THEN array_to_string(string_split(title, ' ')[2:6], ' ') ELSE lower(array_to_string(string_split(abstract, ' ')[2:6], ' ')) END AS q FROM papers),
c AS (SELECT id + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS paper_id, q FROM own WHERE q <> ''),
s AS (SELECT paper_id, q, CASE WHEN paper_id % 2 = 0 THEN title ELSE abstract END AS body FROM c LEFT JOIN papers ON id = paper_id)
SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN 'title' ELSE 'abstract' END AS source, sha1(q) AS quote,
  CASE WHEN NOT contains(trim(regexp_replace({fold_sql("coalesce(body, '')")}, '\\s+', ' ', 'g')), trim(regexp_replace({fold_sql('q')}, '\\s+', ' ', 'g'))) THEN 'unsupported_quotation' END AS failure FROM s"""


def pdf_style_sessions(spark, sf_dir):
    """Documents as text layers: lines in sections by headings."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.regexp_replace("text", r"\. (\p{Lu})", ".\n1 $1").alias("text"))
    out = documents.line_sessions(d)
    return out.select("paper_id", "ord", "heading", F.length(F.regexp_replace("text", r"\s", "")).alias("n_chars"))


# Written out here rather than taken from the operators, so that a wrong one there shows.
_NUMBERED = r"^((?:[1-9]\d?(?:\.\d{1,2})*)|[A-Z])(?:[.)])?\s+(.{2,100})$"
_PLAIN = (
    r"(?i)^(?:abstract|introduction|background|related work|literature review|methods?|methodology|materials(?: and methods)?|datasets?|data|experiments?|experimental setup"
    r"|evaluation(?: setup| metrics)?|metrics|results?(?: and discussion)?|discussion|error analysis|limitations?|future work|future directions?|conclusions?|acknowledg(?:e)?ments?"
    r"|references|bibliography|works cited)$"
)
SESSIONS = rf"""WITH d AS (SELECT doc_id AS paper_id, regexp_replace(text, '\. (\p{{Lu}})', E'.\n1 \\1', 'g') AS text FROM documents),
l AS (SELECT paper_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT paper_id, i, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM l),
m AS (SELECT *, regexp_extract(line, '{_NUMBERED}', 1) AS mk, regexp_extract(line, '{_NUMBERED}', 2) AS ti FROM k),
h AS (SELECT *, length(line) > 0 AND length(line) <= 120 AND (regexp_matches(line, '{_PLAIN}') OR (regexp_matches(line, '{_NUMBERED}')
  AND NOT regexp_matches(trim(ti), '[.;:,]$') AND len(string_split(trim(ti), ' ')) <= 14 AND regexp_matches(ti, '^\p{{L}}') AND (regexp_matches(mk, '^\d') OR regexp_matches(ti, '^\p{{Lu}}')))) AS h FROM m),
s AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY paper_id ORDER BY i) AS ord FROM h),
g AS (SELECT paper_id, CAST(ord AS INTEGER) AS ord, coalesce(max(line) FILTER (h), 'Front matter') AS heading, coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT h), '') AS body FROM s GROUP BY paper_id, ord)
SELECT paper_id, ord, heading, CAST(length(regexp_replace(body, '\s', '', 'g')) AS INTEGER) AS n_chars FROM g WHERE trim(body) <> ''
  AND NOT regexp_matches(lower(trim(regexp_replace(heading, '^(?:(?:\d{{1,2}}(?:\.\d{{1,2}})*)|[A-Z])(?:[.)])?\s+', ''))), '^(?:references|bibliography|works cited)$')"""


def html_sections(spark, sf_dir):
    """Pages as full texts: parsed, bounded and given ids."""
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("paper_id"), F.lit("html").alias("source_format"), F.col("html").alias("body"))
    out = documents.normalise(documents.parse(p))
    return out.select("paper_id", "ord", "section_id", "heading", "section_types", F.length("text").alias("n_chars"), "truncated")


def context_selection(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("paper_id"), F.lit("html").alias("source_format"), F.col("html").alias("body"))
    return documents.choose_context(documents.normalise(documents.parse(p)), 3000).select("paper_id", "ord", "section_id", F.length("text").alias("n_chars"), "cut")


def batch_packing(spark, sf_dir):
    """Documents of a source packed in order, five a batch and 8,000 characters at most."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("queue"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("chars"))
    return documents.pack(d, 5, 8000).select("queue", "ord", "batch")


PACKING = """WITH RECURSIVE d AS (SELECT source AS queue, doc_id AS ord, n_chars AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r(queue, ord, i, batch, n, used) AS (SELECT queue, ord, i, CAST(0 AS BIGINT), 1, chars FROM d WHERE i = 1
  UNION ALL SELECT d.queue, d.ord, d.i, CASE WHEN n >= 5 OR used + 23 + chars > 8000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 5 OR used + 23 + chars > 8000 THEN 1 ELSE n + 1 END,
  CASE WHEN n >= 5 OR used + 23 + chars > 8000 THEN chars ELSE used + 23 + chars END FROM r JOIN d ON d.queue = r.queue AND d.i = r.i + 1)
SELECT queue, ord, batch FROM r"""


def redacted_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha1(t.redact(F.col("text"))).alias("redacted"))


_SECRET = (
    r"(?i)(sk-[a-z0-9_-]+|bearer\s+\S+|(?:api[-_ ]?key|authorization|password|access[-_ ]?token|refresh[-_ ]?token|service[-_ ]?role[-_ ]?key|webhook[-_ ]?secret)\s*[:=]\s*\S+)"
)
REDACTED = rf"""SELECT doc_id, sha1(substr(regexp_replace(regexp_replace(regexp_replace(text, '{_SECRET}', '[redacted]', 'g'), 'https?://\S+', '[url]', 'g'), '\b[^\s@]+@[^\s@]+\b', '[email]', 'g'), 1, 1000)) AS redacted FROM documents"""


def reconstruct_text(spark, sf_dir):
    """Passages to inverted indexes and back."""
    b = load(spark, sf_dir, "benchmark").select("item_id", works.inverted_index(F.col("text")).alias("index"))
    return b.select("item_id", F.size("index").alias("n_words"), works.abstract_text(F.col("index")).alias("text"))


RECONSTRUCT = "SELECT item_id, CAST(len(list_distinct(string_split(text, ' '))) AS INTEGER) AS n_words, text FROM benchmark"


def _records(spark, sf_dir) -> DataFrame:
    """Documents as provider records: equal texts share a DOI, the source is the author."""
    p = papers(spark, sf_dir)
    none = F.array().cast("array<string>")
    return p.select(
        F.col("id").alias("ord"), F.concat(F.lit("d"), "id").alias("id"), "title", "abstract", F.array(F.concat_ws(" ", F.lit("Ann"), F.translate("source", "0123456789", "abcdefghij"))).alias("authors"),
        "publication_year", F.lit(None).cast("date").alias("publication_date"), F.concat(F.lit("10.1/"), F.md5(F.concat_ws("\n", "title", "abstract"))).alias("doi"), none.alias("doi_aliases"),
        F.lit(None).cast("string").alias("openalex_id"), none.alias("openalex_aliases"), none.alias("referenced_work_ids"), F.lit("article").alias("work_type"), (F.col("id") % 100).cast("int").alias("citation_count"),
        "source", F.lit(None).cast("string").alias("url"), F.array().cast("array<struct<url:string,source_format:string>>").alias("full_text_locations"),
    )


def exact_id_components(spark, sf_dir):
    return resolution.clusters_by_id(_records(spark, sf_dir))


ID_COMPONENTS = "SELECT doc_id AS ord, min(doc_id) OVER (PARTITION BY text) AS root FROM documents"


def title_year_groups(spark, sf_dir):
    rows = resolution.title_identity(_records(spark, sf_dir)).where("has_identity")
    return rows.groupBy("title_key", "publication_year").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where("n > 1").select(F.sha1("title_key").alias("title"), "publication_year", "n", "first")


TITLE_YEAR = f"""WITH {PAPERS}, k AS (SELECT id, publication_year, trim(regexp_replace({fold_sql('title')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS k FROM papers)
SELECT sha1(k) AS title, publication_year, count(*) AS n, min(id) AS first FROM k WHERE k <> '' AND k <> 'untitled' GROUP BY k, publication_year HAVING count(*) > 1"""


def near_title_pairs(spark, sf_dir):
    return resolution.near_title_pairs(_records(spark, sf_dir).withColumn("authors", F.array(F.lit("Ann Lee"))))


def resolved_works(spark, sf_dir):
    return resolution.deduplicate(_records(spark, sf_dir)).select("ord", "id", "n_records", F.sha1("title").alias("title"), "citation_count")


def normalised_values(spark, sf_dir):
    """Part names and types as methods, datasets, problems and metrics."""
    p = load(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "Models").when(F.col("p_partkey") % 3 == 1, "data-set").otherwise("Dataset")).alias("v"))
    p = p.union(load(spark, sf_dir, "part").select("p_type")).distinct()
    return p.select("v", f.method(F.col("v")).alias("method"), f.dataset(F.col("v")).alias("dataset"), f.problem(F.col("v")).alias("problem"), f.metric_kind(F.col("v")).alias("kind"), t.gap_key(F.col("v")).alias("key"))


_METHOD_LIST = (
    "'method', 'methods', 'model', 'models', 'approach', 'approaches', 'technique', 'techniques', 'algorithm', 'algorithms', 'architecture', 'architectures', 'framework', 'frameworks',"
    " 'proposed method', 'proposed model', 'our method', 'our model'"
)
_GENERIC_DATASET = (
    r"^(?:dataset|datasets|data|benchmark|benchmark datasets?|public datasets?|private datasets?|custom datasets?|proprietary datasets?|several datasets?|multiple datasets?|various datasets?"
    r"|different datasets?|several public datasets?|multiple public datasets?|widely used datasets?)$"
)
_SENTENCE = (
    r"\b(?:we|this paper|this study|our work|the authors|propose|proposes|proposed|develop|developed|evaluate|evaluated|investigate|investigated|achieve|achieved|outperform|outperformed"
    r"|using|used to)\b"
)
NORMALISED = rf"""WITH p AS (SELECT DISTINCT v FROM (SELECT p_name || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'Models' WHEN 1 THEN 'data-set' ELSE 'Dataset' END AS v FROM part UNION ALL SELECT p_type FROM part)),
k AS (SELECT v, {_key_sql('v')} AS k FROM p),
m AS (SELECT *, trim(regexp_replace(k, '\b(?:model|models|architecture|architectures)$', '')) AS bare, trim(regexp_replace(k, '\s+(?:dataset|datasets|corpus|cohort)$', '')) AS db FROM k)
SELECT v, CASE WHEN k IN ({_METHOD_LIST}) OR bare IN ({_METHOD_LIST}) THEN '' ELSE bare END AS method,
  CASE WHEN regexp_matches(k, '{_GENERIC_DATASET}') OR regexp_matches(db, '{_GENERIC_DATASET}') OR regexp_matches(db, '{_SENTENCE}') THEN '' ELSE db END AS dataset,
  CASE WHEN regexp_matches(k, '{_SENTENCE}') THEN '' ELSE k END AS problem, CASE WHEN NOT regexp_matches(k, '{_SENTENCE}') THEN 'performance' END AS kind,
  substr(sha1(array_to_string(regexp_extract_all(lower(v), '[a-z0-9]+'), ' ')), 1, 16) AS key FROM m"""


def _idea(spark) -> DataFrame:
    rows = [("problem", "1-URGENT"), ("constraint", "R"), ("method", "Brand#13"), ("method", "the brand 7 model"), ("dataset", "PROMO dataset")]
    return spark.createDataFrame(rows, "dimension string, value string")


def _terms(spark):
    return F.array(*map(F.lit, ("urgent", "brand", "nation", "3")))


def _anchored(spark, sf_dir, rows: DataFrame | None = None):
    rows = rows if rows is not None else line_features(spark, sf_dir)
    freq = landscape.frequencies(rows, rows.select("paper_id").distinct(), once=True)
    return gaps.idea_anchor(freq, _idea(spark), _terms(spark))


def idea_anchors(spark, sf_dir):
    return gaps.top_values(_anchored(spark, sf_dir)).select("dimension", "value", "count", "anchored")


_TOP = f"""{LINES}, fr AS (SELECT dimension, value, count(*) AS count FROM features WHERE dimension IN ('problem', 'method_family', 'dataset', 'baseline', 'constraint') GROUP BY ALL),
an AS (SELECT *, CASE dimension WHEN 'problem' THEN value = '1-URGENT' WHEN 'constraint' THEN value = 'R' WHEN 'method_family' THEN value IN ('Brand#13') WHEN 'dataset' THEN value = 'PROMO' ELSE false END AS anchored FROM fr),
top AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY anchored DESC, count DESC, lower(value), value) AS n FROM an QUALIFY n <= 4)"""
ANCHORS = f"WITH {_TOP} SELECT dimension, value, count, anchored FROM top"


def unobserved_combinations(spark, sf_dir):
    """Five values down to two that no order line holds together, in dimensions that the idea names values of, one of them a value it names."""
    sets = staged_sets(spark, sf_dir)
    freq = landscape.frequencies(rows_of(sets), sets.select("paper_id"), once=True)
    top = Staged(gaps.top_values(gaps.idea_anchor(freq, _idea(spark), _terms(spark))).select("dimension", "value", "count", "anchored"), "top").df
    held = Staged(gaps.held_values(top, sets), "held").df
    out = reduce(DataFrame.unionByName, [gaps.unobserved(top, held, n) for n in (5, 4, 3, 2)])
    return out.select(F.concat_ws("&", F.transform("dims", lambda d: F.concat_ws("=", d["dimension"], d["value"]))).alias("dims"), F.col("n_anchored").cast("long"), "count")


_COMPARED = "list_position(['problem','population_or_setting','method_family','dataset','dataset_type','baseline','constraint'], dimension)"


def _unobserved_sql(size: int) -> str:
    names = [f"x{i}" for i in range(size)]
    total = lambda c: " + ".join(f"{x}.{c}" for x in names)
    dims = " || '&' || ".join(f"{x}.d" for x in names)
    chain = "v x0 " + " ".join(f"JOIN v {b} ON {a}.i < {b}.i" for a, b in zip(names, names[1:]))
    same = "o x0 " + " ".join(f"JOIN o {b} ON {a}.paper_id = {b}.paper_id AND {a}.i < {b}.i" for a, b in zip(names, names[1:]))
    return (
        f"SELECT {dims} AS dims, CAST({total('a')} AS BIGINT) AS n_anchored, CAST({total('count')} AS BIGINT) AS count FROM {chain} WHERE {total('x')} >= 2 AND {total('a')} > 0"
        f" AND {dims} NOT IN (SELECT {dims} FROM {same})"
    )


UNOBSERVED = f"""WITH {_TOP}, v AS (SELECT {_COMPARED} AS i, dimension || '=' || value AS d, CAST(anchored AS INTEGER) AS a, max(CAST(anchored AS INTEGER)) OVER (PARTITION BY dimension) AS x, count FROM top),
o AS (SELECT paper_id, {_COMPARED} AS i, dimension || '=' || value AS d FROM features WHERE dimension || '=' || value IN (SELECT d FROM v))
{" UNION ALL ".join(_unobserved_sql(n) for n in (5, 4, 3, 2))}"""


def _claims(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """Features (of orders, unless given) as claims in their fields; every third paper speaks of comparing."""
    field = F.create_map(*[F.lit(x) for x in ("problem", "research_objective", "method", "method_or_intervention", "method_family", "method_or_intervention", "dataset", "datasets", "baseline", "comparison_or_baseline", "constraint", "constraints")])
    rows = (rows if rows is not None else features(spark, sf_dir)).where(F.col("dimension") != "study_type")
    said = F.when(F.substring_index(F.col("paper_id").cast("string"), "-", 1).cast("long") % 3 == 0, "is compared with others").otherwise("stands alone")
    return rows.select("paper_id", "dimension", F.element_at(field, F.col("dimension")).alias("field"), F.xxhash64("dimension", "value").alias("ord"), "value", F.concat_ws(" ", "value", said).alias("evidence_text"), F.lit("abstract").alias("source"))


def _compared_brands(spark) -> DataFrame:
    """An idea that asks to compare the brands five by five."""
    rows = [("comparison", "Brand " + " versus Brand ".join(str(5 * d + i) for i in range(1, 6))) for d in range(5)]
    return spark.createDataFrame(rows, "dimension string, value string")


def missing_comparison_pairs(spark, sf_dir):
    """Families of two orders each that the idea compares and no order does; the dearest orders are those that speak of comparing."""
    rows = Staged(features(spark, sf_dir), "features").df
    freq = landscape.frequencies(rows, feature_papers(spark, sf_dir), once=True)
    dear = load(spark, sf_dir, "orders").where("o_totalprice > 499000").select(F.col("o_orderkey").alias("paper_id"), F.lit(True).alias("dear")).distinct()
    said = F.when(F.col("dear"), "compared with others").otherwise("alone")
    claims = _claims(spark, sf_dir, rows).join(verification._small(dear, 500_000), "paper_id", "left").withColumn("evidence_text", said)
    of = Staged(gaps.sides(claims), "sides").df
    return gaps.missing_comparisons(freq, gaps.observed_pairs(claims, of), gaps.justified_pairs(claims, _compared_brands(spark), of))


MISSING_PAIRS = f"""WITH {FEATURES}, fam AS (SELECT regexp_replace(lower(value), '#', ' ') AS k, count(*) AS n FROM features WHERE dimension = 'method_family' GROUP BY 1 HAVING count(*) >= 2),
m AS (SELECT paper_id, regexp_replace(lower(value), '#', ' ') AS v FROM features WHERE dimension = 'method_family' AND paper_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 499000)),
o AS (SELECT DISTINCT x.v AS a, y.v AS b FROM m x JOIN m y ON x.paper_id = y.paper_id AND x.v < y.v)
SELECT x.k AS "left", y.k AS "right", x.n AS left_count, y.n AS right_count FROM fam x JOIN fam y ON x.k < y.k AND (CAST(substr(x.k, 7) AS INTEGER) - 1) // 5 = (CAST(substr(y.k, 7) AS INTEGER) - 1) // 5 WHERE (x.k, y.k) NOT IN (SELECT (a, b) FROM o)"""

_REQ = [
    (1, "problem", "p1", "urgent"), (1, "method", "m1", "Brand 13"), (1, "method", "m1", "Brand 7"), (1, "constraint", "c1", "R"),
    (2, "problem", "p1", "medium"), (2, "data_or_modality", "d1", "promo"), (2, "data_or_modality", "d2", "economy"), (3, "comparison", "b1", "nation 3"), (3, "comparison", "b2", "nation 4"),
]


def _requirements(spark):
    return spark.createDataFrame(_REQ, "idea_id int, facet string, grp string, value string")


def idea_match_division(spark, sf_dir):
    """Orders that meet every facet of an idea, or some: relational division over claims."""
    req = _requirements(spark)
    claims = Staged(_claims(spark, sf_dir), "claims").df
    out = verification.match_strength(verification.group_matches(claims, req), req)
    return out.select("idea_id", "paper_id", F.concat_ws(",", "facets").alias("facets"), "complete")


def _stem_sql(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 5 AND {w} LIKE '%ies' THEN left({w}, -3) || 'y' WHEN length({w}) > 6 AND {w} LIKE '%tion' THEN left({w}, -3) || 't' WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN left({w}, -3)"
        f" WHEN length({w}) > 5 AND {w} LIKE '%ed' THEN left({w}, -2) WHEN length({w}) > 5 AND {w} LIKE '%s' THEN left({w}, -1) ELSE {w} END"
    )


def _forms_sql(w: str) -> str:
    return (
        f"CASE WHEN {w} IN ('reduces', 'reduced', 'reducing', 'reduction', 'reductions', 'decrease', 'decreases', 'decreased', 'decreasing') THEN 'reduce'"
        f" WHEN {w} IN ('improves', 'improved', 'improving', 'improvement', 'improvements') THEN 'improve' WHEN {w} IN ('increases', 'increased', 'increasing') THEN 'increase' ELSE {w} END"
    )


def _concepts_sql(c: str) -> str:
    """The concepts of a phrase in DuckDB, by lists of its own."""
    stop = "'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'under', 'with'"
    buckets = "'other', 'unknown', 'misc', 'miscellaneous', 'unspecified', 'uncategorized', 'none'"
    placeholder = (
        "\\b(?:other|unknown|misc|miscellaneous|unspecified|uncategorized|none)(?:\\s+(?:method|methods|model|models|approach|approaches|technique|techniques"
        "|population|populations|setting|settings|dataset|datasets|data|baseline|baselines))?\\b"
    )
    words = f"list_filter(regexp_extract_all(regexp_replace({_key_sql(c)}, '{placeholder}', ' ', 'g'), '[a-z0-9]+'), lambda w: w NOT IN ({stop}, {buckets}))"
    formed = f"list_transform({words}, lambda w: {_forms_sql('w')})"
    return f"list_distinct(list_transform({formed}, lambda w: {_stem_sql('w')}))"


def _phrase_sql(need: str, have: str) -> str:
    return f"(len({need}) > 0 AND len({have}) > 0 AND (list_has_all({have}, {need}) OR list_has_all({need}, {have})))"


def _said_sql(value: str, said: str) -> str:
    """Value and evidence text of _claims."""
    return f"{value} || ' ' || {value} || CASE {said} WHEN 0 THEN ' is compared with others' ELSE ' stands alone' END"


_FIELD = "CASE dimension WHEN 'problem' THEN 'research_objective' WHEN 'dataset' THEN 'datasets' WHEN 'baseline' THEN 'comparison_or_baseline' WHEN 'constraint' THEN 'constraints' ELSE 'method_or_intervention' END"
# The fields that speak for a facet or support it.
_FACETS = """WHEN facet = 'problem' THEN field IN ('research_objective', 'population_or_setting', 'method_or_intervention', 'comparison_or_baseline', 'data_or_modality', 'datasets', 'constraints')
WHEN facet = 'method' THEN field IN ('method_or_intervention', 'research_objective', 'population_or_setting', 'comparison_or_baseline', 'data_or_modality', 'datasets', 'main_findings')
WHEN facet = 'data_or_modality' THEN field IN ('data_or_modality', 'datasets', 'research_objective', 'population_or_setting', 'method_or_intervention', 'main_findings')
WHEN facet = 'constraint' THEN field IN ('constraints', 'research_objective', 'population_or_setting', 'method_or_intervention', 'comparison_or_baseline', 'datasets')
WHEN facet = 'comparison' THEN field IN ('comparison_or_baseline', 'method_or_intervention', 'main_findings')"""
DIVISION = f"""WITH {FEATURES}, c AS (SELECT DISTINCT paper_id, {_FIELD} AS field, value, paper_id % 3 AS said FROM features WHERE dimension <> 'study_type'),
u AS (SELECT DISTINCT field, value, said, {_concepts_sql(_said_sql('value', 'said'))} AS ct FROM c),
req(idea_id, facet, grp, v) AS (VALUES {', '.join(map(str, _REQ))}), r AS (SELECT *, {_concepts_sql('v')} AS need FROM req),
m AS (SELECT DISTINCT idea_id, facet, grp, field, value, said FROM u JOIN r ON (CASE {_FACETS} END) AND {_phrase_sql('need', 'ct')}),
g AS (SELECT DISTINCT idea_id, facet, grp, paper_id FROM m JOIN c USING (field, value, said)),
q AS (SELECT idea_id, facet, count(DISTINCT grp) AS n FROM req GROUP BY ALL), qq AS (SELECT idea_id, count(*) AS n FROM q GROUP BY ALL),
k AS (SELECT idea_id, facet, paper_id, count(DISTINCT grp) AS k FROM g GROUP BY ALL), f AS (SELECT k.* FROM k JOIN q USING (idea_id, facet) WHERE k = n)
SELECT idea_id, paper_id, string_agg(facet, ',' ORDER BY facet) AS facets, count(*) = any_value(n) AS complete FROM f JOIN qq USING (idea_id) GROUP BY idea_id, paper_id"""


def prescreen_labels(spark, sf_dir):
    """Every document against the passage its number falls to; the first two words of a passage are groups, the third an alternative of the second."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idea_id"), F.split("text", " ").alias("w"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    p = papers(spark, sf_dir).join(F.broadcast(n)).select((F.col("id") % F.col("n")).alias("idea_id"), F.col("id").alias("paper_id"), "title", "abstract")
    pair = lambda g, i: F.struct(F.lit(g).alias("grp"), F.try_element_at("w", F.lit(i)).alias("value"))
    req = items.select("idea_id", F.inline(F.array(pair("a", 1), pair("b", 2), pair("b", 3)))).where("value is not null")
    none = p.select("idea_id", "paper_id", F.lit(0.0).alias("score"))
    return verification.prescreen(p, req, none.withColumn("score", F.when(F.col("paper_id") % 7 == 0, 0.8).otherwise(0.1)))


PRESCREEN = f"""WITH {PAPERS}, n AS (SELECT count(*) AS n FROM benchmark), p AS (SELECT id % n AS idea_id, id AS paper_id, {_concepts_sql("title || ' ' || abstract")} AS c FROM papers, n),
w AS (SELECT item_id AS idea_id, string_split(text, ' ') AS w FROM benchmark), q AS (SELECT idea_id, 'a' AS grp, w[1] AS v FROM w UNION SELECT idea_id, 'b', w[2] FROM w UNION SELECT idea_id, 'b', w[3] FROM w),
r AS (SELECT idea_id, grp, {_concepts_sql('v')} AS need FROM q WHERE v IS NOT NULL), rr AS (SELECT * FROM r WHERE len(need) > 0), g AS (SELECT idea_id, count(DISTINCT grp) AS g FROM rr GROUP BY idea_id),
k AS (SELECT idea_id, count(*) AS n FROM p GROUP BY idea_id), h AS (SELECT p.idea_id, paper_id, count(DISTINCT grp) AS n FROM p JOIN rr ON p.idea_id = rr.idea_id AND list_has_all(c, need) GROUP BY ALL),
t AS (SELECT p.idea_id, p.paper_id, coalesce(h.n, 0) AS n, g.g, k.n AS papers, p.paper_id % 7 = 0 AS strong FROM p LEFT JOIN h USING (idea_id, paper_id) LEFT JOIN g ON g.idea_id = p.idea_id JOIN k ON k.idea_id = p.idea_id)
SELECT idea_id, paper_id, n AS n_covered, CASE WHEN papers < 2 OR g IS NULL THEN 'uncertain' WHEN n >= least(2, g) OR (n > 0 AND strong) THEN 'accepted' WHEN n > 0 OR strong THEN 'uncertain' ELSE 'rejected' END AS verdict FROM t"""


def _lines(spark, sf_dir):
    """Order lines as sets and as rows, and the frequencies of their values, written once."""
    sets = staged_sets(spark, sf_dir)
    lines = rows_of(sets)
    return sets, lines, Staged(landscape.frequencies(lines, sets.select("paper_id"), once=True), "frequencies").df


def gap_candidates(spark, sf_dir):
    """What all builders propose for the idea from order lines, with their support and relevance: the first 50."""
    sets, lines, freq = _lines(spark, sf_dir)
    members = landscape.members(lines, once=True)
    out, _, _ = gaps.generate(sets, 0, freq, members, _claims(spark, sf_dir, lines), _idea(spark), _terms(spark), limit=50)
    return out.select("rank", "candidate_id", "pattern_type", "title", "n_support", F.round("idea_relevance", 6).alias("idea_relevance"), F.round("idea_anchor_score", 6).alias("idea_anchor_score"))


def _combinations(spark, sf_dir):
    """(combination candidates in priority order of their columns, basis, lines)."""
    sets, lines, freq = _lines(spark, sf_dir)
    values = Staged(gaps.idea_anchor(freq, _idea(spark), _terms(spark)).select("dimension", "value", "count", "prevalence", "anchored").withColumn("strong", F.lit(True)), "anchored").df
    rows, basis = gaps.combination_builder(sets, values)
    ranked = gaps.prioritise(gaps.relevance(rows, basis, _terms(spark)).withColumn("n_support", F.lit(2)), basis)
    return Staged(ranked, "ranked").df, basis, lines


def pruned_candidates(spark, sf_dir):
    ranked, _, _ = _combinations(spark, sf_dir)
    return gaps.prune(ranked)


def verification_order(spark, sf_dir):
    """The candidates that are verified: eligible, pruned, in order of priority, less those that an order line shows."""
    ranked, basis, lines = _combinations(spark, sf_dir)
    fit = verification.eligible(ranked, basis)
    return verification.select_for_verification(fit, gaps.prune(fit), verification.observed(basis, _claims(spark, sf_dir, lines)), 10).select("candidate_id", "title")


def verification_labels(spark, sf_dir):
    """Labels of the candidates: some have failures, some possible matches; those that a line about the idea answers are well studied."""
    ranked, basis, lines = _combinations(spark, sf_dir)
    claims = _claims(spark, sf_dir, lines)
    topic = spark.createDataFrame([("problem", "1-URGENT"), ("intervention_or_method", "Brand 13")], "facet string, value string")
    met = verification.direct_counterexamples(ranked, basis, claims, verification.topic_papers(topic, claims)).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("confirmed"))
    n = F.crc32("candidate_id") % 10
    state = ranked.join(met, "candidate_id", "left").select(
        "candidate_id", F.when(n == 0, 1).otherwise(0).alias("failures"), F.when(n == 1, 0).otherwise(5).alias("n_papers"), F.when(n == 2, 0).otherwise(5).alias("n_records"),
        F.lit(4).alias("n_with_abstract"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"), F.when(n == 3, 1).otherwise(0).alias("potential"),
    )
    return verification.candidate_label(state).select("candidate_id", "label")


def topic_lines(spark, sf_dir):
    """Order lines whose claims are about an idea, by its problem, methods or modality."""
    lines = staged_lines(spark, sf_dir)
    topic = spark.createDataFrame([("problem", "2 high"), ("intervention_or_method", "the other method of Brand 13"), ("data_or_modality", "economy brushed tin"), ("constraints", "R")], "facet string, value string")
    return verification.topic_papers(topic, _claims(spark, sf_dir, lines))


TOPIC_LINES = f"""WITH {LINES}, c AS (SELECT paper_id, {_FIELD} AS field, value, CAST(split_part(paper_id, '-', 1) AS BIGINT) % 3 AS said FROM features),
u AS (SELECT DISTINCT field, value, said, {_concepts_sql(_said_sql('value', 'said'))} AS ct FROM c),
w(field, v) AS (VALUES ('research_objective', '2 high'), ('method_or_intervention', 'the other method of Brand 13'), ('datasets', 'economy brushed tin')), n AS (SELECT field, {_concepts_sql('v')} AS need FROM w),
m AS (SELECT DISTINCT field, value, said FROM u JOIN n USING (field) WHERE {_phrase_sql('need', 'ct')})
SELECT DISTINCT paper_id FROM c JOIN m USING (field, value, said)"""


def observed_candidates(spark, sf_dir):
    """Order lines that hold a frequent pair (problem, family) in the proper fields: candidates that are no gaps."""
    lines = staged_lines(spark, sf_dir)
    top = Staged(gaps.top_values(_anchored(spark, sf_dir, lines)), "top").df
    a = top.where("dimension = 'problem'").select(F.col("value").alias("x"))
    b = top.where("dimension = 'method_family'").select(F.col("value").alias("y"))
    pairs = a.join(F.broadcast(b)).select(F.concat_ws("|", "x", "y").alias("candidate_id"), "x", "y")
    basis = pairs.select("candidate_id", F.inline(F.array(F.struct(F.lit("problem").alias("dimension"), F.col("x").alias("value")), F.struct(F.lit("method_family").alias("dimension"), F.col("y").alias("value")))))
    return verification.observed(basis, _claims(spark, sf_dir, lines)).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))


OBSERVED = f"""WITH {_TOP}, c AS (SELECT dimension, value, paper_id, CAST(split_part(paper_id, '-', 1) AS BIGINT) % 3 AS said FROM features WHERE dimension IN ('problem', 'method', 'method_family')),
u AS (SELECT dimension, value, said, {_concepts_sql(_said_sql('value', 'said'))} AS ct FROM (SELECT DISTINCT dimension, value, said FROM c)),
n AS (SELECT dimension, value AS want, {_concepts_sql('value')} AS need FROM top WHERE dimension IN ('problem', 'method_family')),
m AS (SELECT DISTINCT n.dimension AS d, want, u.dimension, u.value, said FROM n JOIN u ON (n.dimension = 'problem') = (u.dimension = 'problem') AND {_phrase_sql('need', 'ct')}),
p AS (SELECT DISTINCT d, want, paper_id FROM m JOIN c USING (dimension, value, said))
SELECT a.want || '|' || b.want AS candidate_id, count(*) AS n FROM p a JOIN p b USING (paper_id) WHERE a.d = 'problem' AND b.d = 'method_family' GROUP BY 1"""


def cache_latest(spark, sf_dir):
    """Events as cache entries: the newest of each user and type, if it is younger than ten days at the month's end."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("stored_at"), "event_id")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    newest = caches.latest(e, ["user_id", "event_type"])
    return caches.fresh(newest, now, 10 * 86400).select("user_id", "event_type", "event_id")


CACHE = """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1)
SELECT user_id, event_type, event_id FROM l WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) < 864000"""


def attribution(spark, sf_dir):
    p = papers(spark, sf_dir)
    q = p.select("title", "abstract", F.when(F.col("id") % 2 == 0, "title").when(F.col("id") % 5 == 0, "full_text").otherwise("abstract").alias("source"), F.array_join(F.slice(F.split("title", " "), 1, 3), "-").alias("evidence_text"))
    out = evaluation.attribution(q)
    return out.select("total_claims", "supported_claims", F.round("supported_claim_rate", 6).alias("supported_claim_rate"))


ATTRIBUTION = f"""WITH {PAPERS}, q AS (SELECT CASE WHEN id % 2 = 0 THEN title WHEN id % 5 = 0 THEN NULL ELSE abstract END AS body, array_to_string(string_split(title, ' ')[1:3], '-') AS s FROM papers),
k AS (SELECT {_key_sql('s')} AS s, {_key_sql('body')} AS b FROM q)
SELECT count(*) AS total_claims, count(*) FILTER (s <> '' AND contains(b, s)) AS supported_claims, round(count(*) FILTER (s <> '' AND contains(b, s)) / count(*), 6) AS supported_claim_rate FROM k"""

QUERIES = {
    g.__name__: g
    for g in (
        evidence_support, pdf_style_sessions, html_sections, context_selection, batch_packing, redacted_text, reconstruct_text, exact_id_components, title_year_groups,
        near_title_pairs, resolved_works, normalised_values, idea_anchors, unobserved_combinations, missing_comparison_pairs, idea_match_division, prescreen_labels,
        gap_candidates, pruned_candidates, verification_order, verification_labels, topic_lines, observed_candidates, cache_latest, attribution,
    )
}
SQL = {
    "evidence_support": SUPPORT, "pdf_style_sessions": SESSIONS, "batch_packing": PACKING, "redacted_text": REDACTED, "reconstruct_text": RECONSTRUCT,
    "exact_id_components": ID_COMPONENTS, "title_year_groups": TITLE_YEAR, "normalised_values": NORMALISED, "idea_anchors": ANCHORS, "unobserved_combinations": UNOBSERVED,
    "missing_comparison_pairs": MISSING_PAIRS, "idea_match_division": DIVISION, "prescreen_labels": PRESCREEN, "observed_candidates": OBSERVED, "topic_lines": TOPIC_LINES, "cache_latest": CACHE,
    "attribution": ATTRIBUTION,
}
