"""Registered queries on landscapes, evaluation and operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evaluation, landscape, operations
from siltstone.plans.views import FEATURES, feature_papers, features, load
from siltstone.sources.staging import dealt


def feature_frequency(spark, sf_dir):
    out = landscape.frequencies(features(spark, sf_dir), feature_papers(spark, sf_dir), once=True)
    return out.select("dimension", "value", "count", F.round("prevalence", 9).alias("prevalence"))


FREQUENCY = f"""WITH {FEATURES}, n AS (SELECT count(*) AS n FROM fpapers)
SELECT dimension, value, count(*) AS count, round(count(*) / any_value(n), 9) AS prevalence FROM features, n GROUP BY dimension, value"""


def feature_members(spark, sf_dir):
    return landscape.members(features(spark, sf_dir), once=True).select("dimension", "value", "paper_id")


MEMBERS = f"WITH {FEATURES} SELECT dimension, value, paper_id FROM features"


def _combos(size):
    def query(spark, sf_dir):
        out = landscape.combos(features(spark, sf_dir), feature_papers(spark, sf_dir), size, once=True)
        names = F.concat_ws("&", F.transform("dims", lambda d: F.concat_ws("=", d["dimension"], d["value"])))
        return out.select(names.alias("dims"), "count", F.round("prevalence", 9).alias("prevalence"))

    return query


_PLACE = "list_position(['problem','population_or_setting','method','method_family','dataset','dataset_type','baseline','constraint'], dimension)"


def _combos_sql(size: int) -> str:
    tables = ", ".join(f"f AS f{i}" for i in range(size))
    joins = " AND ".join(f"f{i}.paper_id = f{i + 1}.paper_id AND f{i}.p < f{i + 1}.p" for i in range(size - 1))
    name = " || '&' || ".join(f"f{i}.d" for i in range(size))
    return f"""WITH {FEATURES}, n AS (SELECT count(*) AS n FROM fpapers),
f AS (SELECT paper_id, {_PLACE} AS p, dimension || '=' || value AS d FROM features WHERE {_PLACE} > 0
  AND paper_id IN (SELECT paper_id FROM fpapers WHERE study_type IN ('empirical', 'methodological')))
SELECT {name} AS dims, count(DISTINCT f0.paper_id) AS count, round(count(DISTINCT f0.paper_id) / any_value(n), 9) AS prevalence FROM {tables}, n WHERE {joins} GROUP BY 1"""


def missing_fields(spark, sf_dir):
    return landscape.missing_fields(features(spark, sf_dir), feature_papers(spark, sf_dir)).select("field", "n_missing")


MISSING = f"""WITH {FEATURES}, names(field, dimension) AS (VALUES {", ".join(f"('{k}', '{d}')" for k, d in landscape.MISSING)})
SELECT field, (SELECT count(*) FROM fpapers) - count(DISTINCT paper_id) AS n_missing FROM names LEFT JOIN features USING (dimension) GROUP BY field"""


def _coverage(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    level = F.element_at(F.array(*map(F.lit, landscape.SOURCE_LEVELS)), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, landscape.FULL_TEXT_STATUS)), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(level.alias("source_level"), status.alias("full_text_status"), (F.col("value") > 50).alias("truncated"))


def source_coverage(spark, sf_dir):
    return landscape.source_coverage(_coverage(spark, sf_dir))


COVERAGE = """WITH c AS (SELECT ['full_text','abstract','abstract_fallback'][event_id % 3 + 1] AS l, ['usable','unavailable','fetch_failed','parse_failed'][user_id % 4 + 1] AS s, value > 50 AS t FROM events),
names(kind, name) AS (VALUES ('source_level','full_text'),('source_level','abstract'),('source_level','abstract_fallback'),('source_level','metadata_only'),('full_text_status','usable'),
  ('full_text_status','unavailable'),('full_text_status','fetch_failed'),('full_text_status','parse_failed'),('full_text_status','not_attempted'),('truncated','usable')),
p AS (SELECT 'source_level' AS kind, l AS name FROM c UNION ALL SELECT 'full_text_status', s FROM c UNION ALL SELECT 'truncated', 'usable' FROM c WHERE t AND s = 'usable')
SELECT kind, name, count(p.name) AS n FROM names LEFT JOIN p USING (kind, name) GROUP BY kind, name"""


def _studies(spark, sf_dir):
    """Customers as studies: nations are problems, segments families and metrics, order statuses tell the finding."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    found = F.when(F.col("o_orderstatus") == "F", "it outperforms the others").when(F.col("o_orderstatus") == "P", "it does not outperform the others")
    outcomes = o.groupBy("o_custkey").agg(F.collect_set(found).alias("outcomes"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    j = c.join(outcomes, c["c_custkey"] == outcomes["o_custkey"])
    one = lambda x: F.array(F.col(x).cast("string"))
    return j.select(
        F.col("c_custkey").alias("paper_id"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 5 == 0, "review").otherwise("empirical").alias("study_type"),
        one("c_nationkey").alias("problems"), one("c_mktsegment").alias("method_families"), F.array(F.lit("accuracy"), F.lit("none")).alias("performance_metrics"),
        F.when(F.col("c_acctbal") > 0, F.array((F.col("c_custkey") % 3).cast("string"))).otherwise(F.array().cast("array<string>")).alias("datasets"),
        F.slice("priorities", 1, 1).alias("populations"), F.array().cast("array<string>").alias("baselines"), F.array(F.lit("unknown")).alias("constraints"), "outcomes",
    )


def conflict_pairs(spark, sf_dir):
    return landscape.conflicts(_studies(spark, sf_dir))


CONFLICTS = """WITH o AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS pos, bool_or(o_orderstatus = 'P') AS neg, min(o_orderpriority) AS pr FROM orders GROUP BY o_custkey),
s AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS p, c_mktsegment AS m, CASE WHEN c_acctbal > 0 THEN CAST(c_custkey % 3 AS VARCHAR) END AS d, pr, pos, neg
  FROM customer JOIN o ON c_custkey = o_custkey WHERE c_custkey % 5 <> 0)
SELECT a.id AS left_id, b.id AS right_id, a.p AS topic FROM s a JOIN s b ON a.id < b.id AND a.p = b.p AND a.m = b.m AND a.d IS NOT DISTINCT FROM b.d AND a.pr = b.pr
WHERE (a.pos AND b.neg) OR (a.neg AND b.pos)"""


def top_values(spark, sf_dir):
    out = landscape.top_values(landscape.frequencies(features(spark, sf_dir), feature_papers(spark, sf_dir), once=True), 5)
    return out.select("dimension", "value", "count", "rank")


TOP = f"""WITH {FEATURES}, c AS (SELECT dimension, value, count(*) AS count FROM features GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 5"""


def _retrieved(spark, sf_dir):
    """Customers as cases: their orders by price are what was retrieved; urgent and high ones are relevant."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit(" P"), F.col("o_orderkey")).alias("id"), "o_orderpriority", "o_totalprice")
    place = F.row_number().over(operations.Window.partitionBy("case_id").orderBy(F.desc("o_totalprice"), "id"))
    retrieved = o.select("case_id", place.alias("ord"), "id")
    grade = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    return retrieved, o.select("case_id", F.lower(F.trim("id")).alias("id"), grade.alias("grade")), o.select("case_id")


def ir_metrics(spark, sf_dir):
    r, j, _ = _retrieved(spark, sf_dir)
    out = evaluation.ir_metrics(r, j)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_IR = """r AS (SELECT o_custkey AS case_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, ' P' || o_orderkey) AS rank,
  CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 1 ELSE 0 END AS grade FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, id) AS i FROM r WHERE grade > 0),
ideal AS (SELECT case_id, count(*) AS n, sum(CASE WHEN i <= 10 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM g GROUP BY case_id),
h AS (SELECT case_id, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 50) AS h50, min(rank) AS first,
  sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM r WHERE grade > 0 GROUP BY case_id),
m AS (SELECT case_id, coalesce(h10 / n, 0.0) AS recall_10, coalesce(h50 / n, 0.0) AS recall_50, coalesce(1.0 / first, 0.0) AS mrr, coalesce(dcg / idcg, 0.0) AS ndcg_10 FROM ideal LEFT JOIN h USING (case_id))"""
IR = f"WITH {_IR} SELECT case_id, round(recall_10, 6) AS recall_10, round(recall_50, 6) AS recall_50, round(mrr, 6) AS mrr, round(ndcg_10, 6) AS ndcg_10 FROM m"


def ir_macro(spark, sf_dir):
    r, j, cases = _retrieved(spark, sf_dir)
    names = ["recall_10", "recall_50", "mrr", "ndcg_10"]
    out = evaluation.macro(evaluation.ir_metrics(r, j), cases, names)
    return out.select("cases_total", "cases_scored", *[F.round(n, 6).alias(n) for n in names])


IR_MACRO = f"""WITH {_IR}, c AS (SELECT DISTINCT o_custkey AS case_id FROM orders)
SELECT count(*) AS cases_total, count(recall_10) AS cases_scored, round(avg(coalesce(recall_10, 0)), 6) AS recall_10, round(avg(coalesce(recall_50, 0)), 6) AS recall_50,
  round(avg(coalesce(mrr, 0)), 6) AS mrr, round(avg(coalesce(ndcg_10, 0)), 6) AS ndcg_10 FROM c LEFT JOIN m USING (case_id)"""


def dedup_prf(spark, sf_dir):
    """Line pairs of an order as duplicate pairs: by part modulo 7 predicted, by supplier modulo 7 true."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("D"), F.col("l_linenumber")).alias("d"), F.col("l_partkey") % 7, F.col("l_suppkey") % 7)
    line = line.toDF("case_id", "d", "p", "s")

    def pairs(key):
        a = line.select("case_id", F.col("d").alias("left"), F.col(key).alias("k"))
        b = line.select("case_id", F.lower("d").alias("right"), F.col(key).alias("k"))
        return a.join(b, ["case_id", "k"])

    out = evaluation.pair_metrics(pairs("s"), pairs("p"))
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


DEDUP = """WITH l AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS d, l_partkey % 7 AS p, l_suppkey % 7 AS s FROM lineitem),
g AS (SELECT DISTINCT a.c, a.d AS x, b.d AS y FROM l a JOIN l b ON a.c = b.c AND a.s = b.s AND a.d < b.d), q AS (SELECT DISTINCT a.c, a.d AS x, b.d AS y FROM l a JOIN l b ON a.c = b.c AND a.p = b.p AND a.d < b.d),
n AS (SELECT (SELECT count(*) FROM g JOIN q USING (c, x, y)) AS tp, (SELECT count(*) FROM q) AS np, (SELECT count(*) FROM g) AS ng)
SELECT tp, np - tp AS fp, ng - tp AS fn, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * (tp / np) * (tp / ng) / (tp / np + tp / ng), 6) AS f1 FROM n"""


def extraction_prf(spark, sf_dir):
    """Orders as cases, line attributes as fields: even lines are predicted, lines not divisible by three true."""
    line = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("quantity"),
        F.coalesce(F.col("l_linenumber") % 3 != 0, F.lit(False)).alias("gold"), F.coalesce(F.col("l_linenumber") % 2 == 0, F.lit(False)).alias("predicted"),
    ).where("gold or predicted")
    values = F.inline(F.array(
        F.struct(F.lit("flag").alias("field"), F.col("l_returnflag").alias("value")), F.struct(F.lit("quantity").alias("field"), F.col("quantity").cast("string").alias("value")),
        F.struct(F.lit("status").alias("field"), F.concat_ws("-", "l_linestatus", "l_returnflag").alias("value"))))
    # Lines are shuffled by case before they become several values each, into parts that grow in number and not in size.
    met = dealt(line, "case_id", f"{sf_dir}/lineitem.parquet")
    out = evaluation.extraction_metrics(evaluation.marked_counts(met.select("case_id", "gold", "predicted", values)))
    return out.select("field", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact_accuracy")])


EXTRACTION = """WITH v AS (SELECT l_orderkey AS c, l_linenumber AS n, unnest(['flag', 'quantity', 'status']) AS field,
  unnest([lower(l_returnflag), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), lower(l_linestatus || ' ' || l_returnflag)]) AS v FROM lineitem),
g AS (SELECT DISTINCT c, field, v, 1 AS g FROM v WHERE n % 3 <> 0), p AS (SELECT DISTINCT c, field, v, 1 AS p FROM v WHERE n % 2 = 0),
k AS (SELECT c, field, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM g FULL JOIN p USING (c, field, v) GROUP BY c, field),
f AS (SELECT field, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END) AS e FROM k GROUP BY field),
s AS (SELECT field, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, e FROM f),
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM f),
a AS (SELECT * FROM s UNION ALL SELECT 'macro', sum(tp), sum(fp), sum(fn), avg(precision), avg(recall), avg(f1), avg(e) FROM s
  UNION ALL SELECT 'micro', tp, fp, fn, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), NULL FROM t)
SELECT field, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(e, 6) AS exact_accuracy FROM a"""


def _cases(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    lab = lambda c: F.element_at(F.array(*map(F.lit, evaluation.LABELS)), (c + 1).cast("int"))
    ids = lambda m, r: F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("o_orderkey") + i) % m == r), lambda i: F.concat(F.lit(" A"), i.cast("string")))
    return o.select(
        F.col("o_orderkey").alias("case_id"), lab(F.col("o_custkey") % 3).alias("expected"), F.when(F.col("o_orderkey") % 7 != 0, lab(F.col("o_orderkey") % 3)).otherwise("odd").alias("predicted"),
        ids(3, 0).alias("known"), ids(2, 0).alias("searched"), ids(4, 1).alias("confirmed"),
    )


_CASES = """l AS (SELECT ['well_studied', 'promising_gap', 'uncertain'] AS l), c AS (SELECT o_orderkey AS id, l[o_custkey % 3 + 1] AS e, CASE WHEN o_orderkey % 7 <> 0 THEN l[o_orderkey % 3 + 1] END AS p,
  list_filter(range(0, 6), lambda i: (o_orderkey + i) % 3 = 0) AS k, list_filter(range(0, 6), lambda i: (o_orderkey + i) % 2 = 0) AS s, list_filter(range(0, 6), lambda i: (o_orderkey + i) % 4 = 1) AS f FROM orders, l)"""


def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_cases(spark, sf_dir))


CONFUSION = f"""WITH {_CASES}, g AS (SELECT a.x AS expected, b.x AS predicted FROM (SELECT unnest(l) AS x FROM l) a, (SELECT unnest(l) AS x FROM l) b)
SELECT expected, predicted, count(id) AS n FROM g LEFT JOIN c ON expected = e AND predicted = p GROUP BY ALL"""


def label_metrics(spark, sf_dir):
    out = evaluation.label_metrics(_cases(spark, sf_dir))
    return out.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


LABEL = f"""WITH {_CASES}, k AS (SELECT x AS label, count(*) FILTER (e = x AND p = x) AS tp, count(*) FILTER (e <> x AND p = x) AS fp, count(*) FILTER (e = x AND p IS DISTINCT FROM x) AS fn
  FROM c, (SELECT unnest(l) AS x FROM l) GROUP BY x)
SELECT label, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k"""


def verification_summary(spark, sf_dir):
    out = evaluation.verification_summary(_cases(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("rate", "accuracy")) else F.col(c).cast("long").alias(c) for c in out.columns])


VERIFICATION = f"""WITH {_CASES}, t AS (SELECT count(*) AS n, count(p) AS sc, count(*) FILTER (e = p) AS r, count(*) FILTER (len(k) > 0) AS kc, CAST(sum(len(k)) AS BIGINT) AS kn,
  sum(len(list_intersect(k, s))) AS d, sum(len(list_intersect(k, f))) AS f, count(*) FILTER (e = 'well_studied' AND p = 'promising_gap') AS fp, count(*) FILTER (e = 'well_studied') AS w FROM c)
SELECT n AS cases_total, sc AS cases_scored, round(r / n, 6) AS accuracy, kc AS counterexample_cases, kn AS known_counterexamples, round(d / kn, 6) AS discovery_rate,
  round(f / kn, 6) AS confirmation_rate, fp AS false_promising_count, round(fp / w, 6) AS false_promising_rate FROM t"""


def rating_stats(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    r = line.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("candidate_id"), F.when(F.col("l_returnflag") == "N", "overall").otherwise(F.col("l_returnflag")).alias("criterion"), (F.col("l_quantity") % 5 + 1).cast("int").alias("rating"))
    out = evaluation.rating_stats(r)
    return out.select("key", F.round("mean", 6).alias("mean"), "median", "count", F.round("standard_deviation", 6).alias("standard_deviation"))


RATINGS = """SELECT CASE WHEN l_returnflag = 'N' THEN 's' || l_suppkey ELSE 's' || l_suppkey || ':' || l_returnflag END AS key, round(avg(CAST(l_quantity % 5 + 1 AS INTEGER)), 6) AS mean,
  CAST(median(CAST(l_quantity % 5 + 1 AS INTEGER)) AS DOUBLE) AS median, count(*) AS count, round(stddev_pop(CAST(l_quantity % 5 + 1 AS INTEGER)), 6) AS standard_deviation FROM lineitem GROUP BY 1"""


def latency_stats(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("seconds", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    out = evaluation.latency_stats(e, ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "greatest")])


LATENCY = """SELECT event_type, count(s) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(min(s), 6) AS least, round(max(s), 6) AS greatest
FROM (SELECT event_type, CASE WHEN event_id % 9 <> 0 THEN value END AS s FROM events) GROUP BY event_type"""


def _ledger(spark, sf_dir):
    """Grants of a customer's balance and a debit per order, in whole units."""
    grant = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.floor("c_acctbal").alias("amount"))
    debit = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (-F.floor(F.col("o_totalprice") / 1000)).alias("amount"))
    return grant.where("amount > 0").unionByName(debit)


_LEDGER = """ledger AS (SELECT c_custkey AS user_id, CAST(floor(c_acctbal) AS BIGINT) AS amount FROM customer WHERE floor(c_acctbal) > 0
  UNION ALL SELECT o_custkey, -CAST(floor(o_totalprice / 1000) AS BIGINT) FROM orders)"""


def ledger_balance(spark, sf_dir):
    return operations.balances(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), _ledger(spark, sf_dir))


BALANCE = f"WITH {_LEDGER} SELECT c_custkey AS user_id, CAST(coalesce(sum(amount), 0) AS BIGINT) AS balance FROM customer LEFT JOIN ledger ON user_id = c_custkey GROUP BY 1"


def user_list(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 97).alias("created_at"))
    sub = load(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("status"))
    return operations.user_list(c, sub, _ledger(spark, sf_dir), 100)


USERS = f"""WITH {_LEDGER}, b AS (SELECT user_id, sum(amount) AS balance FROM ledger GROUP BY user_id)
SELECT c_custkey AS user_id, c_custkey % 97 AS created_at, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'none' END AS subscription_status, CAST(coalesce(balance, 0) AS BIGINT) AS balance
FROM customer LEFT JOIN b ON user_id = c_custkey ORDER BY created_at DESC, c_custkey LIMIT 100"""


def budget_committed(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "reserved").otherwise("released")
    r = o.select(F.to_date("o_orderdate").alias("budget_day"), status.alias("status"), F.col("o_totalprice").alias("actual_cost_usd"), F.lit(0.25).alias("reserved_cost_usd"))
    return operations.committed(r).select(F.col("budget_day").cast("string").alias("budget_day"), F.round("committed", 2).alias("committed"))


BUDGET = """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS budget_day, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN 0.25 ELSE 0 END), 2) AS committed FROM orders GROUP BY 1"""


def budget_admission(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("analysis_id"))
    return operations.admit_budget(o, 0.5, 0.25).groupBy(F.col("day").cast("string").alias("day")).agg(F.count_if("admitted").alias("admitted"), F.count(F.lit(1)).alias("asked"))


ADMISSION = """WITH f AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey, min(o_orderkey) AS o FROM orders GROUP BY ALL),
r AS (SELECT day, o_custkey, row_number() OVER (PARTITION BY day ORDER BY o) <= 2 AS ok FROM f)
SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (ok) AS admitted, count(*) AS asked FROM orders JOIN r ON CAST(o_orderdate AS DATE) = day AND orders.o_custkey = r.o_custkey GROUP BY day"""


def _usage(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    tokens = lambda m: F.when(F.col("event_id") % m != 0, F.floor(F.col("value") * 10).cast("long"))
    cost = F.when(F.col("event_id") % 5 == 0, F.lit(0.5))
    return e.select(F.col("user_id").alias("analysis_id"), F.col("ts").alias("occurred_at"), tokens(11).alias("input_tokens"), tokens(13).alias("output_tokens"), cost.alias("cost_usd"))


_USAGE = """u AS (SELECT user_id, ts, CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS i, CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS o,
  CASE WHEN event_id % 5 = 0 THEN 0.5 END AS own FROM events), p AS (SELECT *, coalesce(own, (i * 1.0 + o * 2.0) / 1000000) AS cost FROM u)"""


def daily_usage(spark, sf_dir):
    out = operations.daily_usage(operations.priced(_usage(spark, sf_dir), 1.0, 2.0))
    return out.select(F.col("day").cast("string").alias("day"), "request_count", "input_tokens", "output_tokens", F.round("cost_usd", 6).alias("cost_usd"), "unavailable_count")


USAGE = f"""WITH {_USAGE} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS request_count, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
  round(sum(cost), 6) AS cost_usd, count(*) FILTER (i IS NULL OR o IS NULL) AS unavailable_count FROM p GROUP BY CAST(ts AS DATE)"""


def query_cost(spark, sf_dir):
    return operations.query_cost(operations.priced(_usage(spark, sf_dir), 1.0, 2.0), 0.25).select("analysis_id", F.round("cost", 6).alias("cost"))


COST = f"WITH {_USAGE} SELECT user_id AS analysis_id, round(CASE WHEN bool_and(cost IS NOT NULL) THEN sum(cost) ELSE 0.25 END, 6) AS cost FROM p GROUP BY user_id"


def failure_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events").where(F.col("value") > 20).withColumn("day", F.to_date("ts").cast("string"))
    return operations.counts(e, ["day", "event_type"])


FAILURES = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS count FROM events WHERE value > 20 GROUP BY ALL"


def admin_summary(spark, sf_dir):
    return operations.counts(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


ADMIN = "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL"


def metric_rollup(spark, sf_dir):
    return operations.metric_rollup(load(spark, sf_dir, "events"), "props").select("name", F.round("total", 3).alias("total"))


ROLLUP = """SELECT k AS name, round(sum(v), 3) AS total FROM (SELECT unnest(json_keys(props)) AS k, TRY_CAST(unnest(list_transform(json_keys(props), lambda x: json_extract_string(props, '$."' || x || '"'))) AS DOUBLE) AS v FROM events)
WHERE v IS NOT NULL GROUP BY k"""


def latest_event(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("event_created"), F.col("event_id").alias("arrival"), "value")
    return operations.upsert_latest(e, ["user_id", "event_type"]).select("user_id", "event_type", "arrival", "value")


LATEST = """SELECT user_id, event_type, event_id AS arrival, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('hour', ts) DESC, event_id DESC) = 1"""


def history_topn(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("d"))
    return operations.latest(o, [F.desc("d"), F.desc("o_orderkey")], 3, ["o_custkey"]).select("o_custkey", "o_orderkey")


HISTORY = "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3"


def idempotent_events(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("arrival"), "user_id", F.floor("value").alias("ref"))
    return operations.idempotent(e, [["user_id", "ref"]])


IDEMPOTENT = "SELECT event_id AS arrival, user_id, CAST(floor(value) AS BIGINT) AS ref FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY event_id) = 1"


def guest_purge(spark, sf_dir):
    gone = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return operations.purge(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


PURGE = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


def rate_limit_admitted(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "ts", "event_id")
    out = operations.admitted(e, 3, 24 * 3600)
    return out.select("event_id", "admitted")


RATE = """WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
r(key, i, held, event_id, admitted) AS (
  SELECT key, i, [ts], event_id, true FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.i, CASE WHEN len(list_filter(held, lambda t: t >= e.ts - INTERVAL 24 HOUR)) < 3 THEN list_append(list_filter(held, lambda t: t >= e.ts - INTERVAL 24 HOUR), e.ts)
    ELSE list_filter(held, lambda t: t >= e.ts - INTERVAL 24 HOUR) END, e.event_id, len(list_filter(held, lambda t: t >= e.ts - INTERVAL 24 HOUR)) < 3
  FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
SELECT event_id, admitted FROM r"""

QUERIES = {
    "feature_frequency": feature_frequency, "feature_members": feature_members, **{f"feature_combinations_{n}": _combos(n) for n in range(2, 6)}, "missing_fields": missing_fields,
    "source_coverage": source_coverage, "conflict_pairs": conflict_pairs, "top_values": top_values, "ir_metrics": ir_metrics, "ir_macro": ir_macro,
    "dedup_prf": dedup_prf, "extraction_prf": extraction_prf, "confusion_matrix": confusion_matrix, "label_metrics": label_metrics,
    "verification_summary": verification_summary, "rating_stats": rating_stats, "latency_stats": latency_stats, "ledger_balance": ledger_balance,
    "user_list": user_list, "budget_committed": budget_committed, "budget_admission": budget_admission, "daily_usage": daily_usage, "query_cost": query_cost,
    "failure_counts": failure_counts, "admin_summary": admin_summary, "metric_rollup": metric_rollup, "latest_event": latest_event, "history_topn": history_topn,
    "idempotent_events": idempotent_events, "guest_purge": guest_purge, "rate_limit_admitted": rate_limit_admitted,
}
SQL = {
    "feature_frequency": FREQUENCY, "feature_members": MEMBERS, **{f"feature_combinations_{n}": _combos_sql(n) for n in range(2, 6)}, "missing_fields": MISSING,
    "source_coverage": COVERAGE, "conflict_pairs": CONFLICTS, "top_values": TOP, "ir_metrics": IR, "ir_macro": IR_MACRO, "dedup_prf": DEDUP,
    "extraction_prf": EXTRACTION, "confusion_matrix": CONFUSION, "label_metrics": LABEL, "verification_summary": VERIFICATION, "rating_stats": RATINGS,
    "latency_stats": LATENCY, "ledger_balance": BALANCE, "user_list": USERS, "budget_committed": BUDGET, "budget_admission": ADMISSION,
    "daily_usage": USAGE, "query_cost": COST, "failure_counts": FAILURES, "admin_summary": ADMIN, "metric_rollup": ROLLUP, "latest_event": LATEST,
    "history_topn": HISTORY, "idempotent_events": IDEMPOTENT, "guest_purge": PURGE, "rate_limit_admitted": RATE,
}
