"""How far the sources of a language differ in their words: exact divergences between every two of them, and the terms that set each apart.

Counts of a term gather in one wide vector, an array of (source number, count) over the sources that have the term. A term's
vector makes contributions to pairs of sources by higher-order functions; sums by pair combine before they are shuffled.

A source without a term still has a share of it, the same for all terms it lacks. So a pair's value splits exactly: with f(p, q) the value of one term and
z a source's share of a term that it lacks, the sum over all kept terms is V f(z, z'), plus f(p, z') - f(z, z') for each term of the first
source, plus f(z, p') - f(z, z') for each of the second, plus f(p, p') - f(p, z') - f(z, p') + f(z, z') for each term of both. The
second and third parts need how often a source has each count; only the last goes through the vectors, and only over the sources that have the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._common import LOWER, UPPER, small, split_words, stage

#: Documents of a language that a term must be in, the scale of shares, and terms listed a source.
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Rows of sources (about 60 bytes each) that may be broadcast.
BROADCAST_ROWS = 100_000
#: What stands between terms: runs of ASCII letters and of non-ASCII characters.
TERM_BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), by long division three digits at a time: exact while total + kept < 2^63 / 1000."""
    over = total + kept
    rest = count + 1
    digits = F.lit(1).cast("long")
    for i in (2, 1, 0):
        rest = rest * 1000
        digits = digits + _div(rest, over) * (1000**i)
        rest = rest % over
    return digits


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it). Documents are not told apart beyond their rows: a term's first
    occurrence in a row counts the document."""
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    rows = docs.selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source", f"sort_array({split_words(text, TERM_BREAK)}) AS terms")
    firsts = "transform(terms, (t, i) -> struct(t AS term, int(i = 0 OR terms[i - 1] <> t) AS opens))"
    each = rows.selectExpr("lang", "source", f"inline({firsts})")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("opens").alias("d"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every source of every language.

    Part pair: each other source of the language as item, and the sum of gain(p, q) over the language's kept terms, p being the source's share of a
    term and q the other's; kept terms are in at least least_docs documents (rows) of the language. Part term: the kept terms that
    the source has and whose share is above the whole language's, with that gain, the first `top` of them. Ranks go by value, then by item.
    Null text, lang and source are ''. Sources without terms take part; a language with one source has no pairs; without kept
    terms pairs are 0. Rows repeated count as often as they stand there; an empty table gives no rows; other columns are ignored.
    """
    found = counted(docs)
    by_term = Window.partitionBy("lang", "term")
    kept = found.withColumns({"seen": F.sum("d").over(by_term), "whole": F.sum("n").over(by_term), "one": F.row_number().over(by_term.orderBy("source"))})
    entries = stage(kept.where(F.col("seen") >= least_docs).select("lang", "source", "term", "n", "whole", (F.col("one") == 1).cast("long").alias("one")), "entries")

    # Totals by source, then by language; every source that occurs has a number in its language.
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("one").alias("ones"))
    occurring = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = occurring.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "ones"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"kept": F.sum("ones").over(by_lang), "lang_total": F.sum("total").over(by_lang), "s": F.row_number().over(by_lang.orderBy("source"))})
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)
    groups = stage(groups.select("lang", "source", "s", "total", "kept", "lang_total", zero.alias("z")), "sources")
    sized = small(groups, BROADCAST_ROWS)

    shares = entries.join(sized, ["lang", "source"])
    shares = shares.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("whole"), F.col("lang_total"), F.col("kept"))})
    return _terms(shares, top).unionByName(_pairs(shares, groups, sized))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    above = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return above.withColumn("rank", rank).where(F.col("rank") <= top)


def _pairs(shares: DataFrame, groups: DataFrame, sized: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    vectors = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p", "z")).alias("v")).where(F.size("v") > 1)
    # One row for each source of a vector, so that a term of many sources makes its pairs a source at a time.
    sides = vectors.select("lang", F.explode("v").alias("a"), "v")
    both = sides.select("lang", F.explode(F.transform(F.filter("v", lambda x: x["s"] != F.col("a")["s"]), lambda x: _both(F.col("a"), x))).alias("c"))
    both = both.select("lang", "c.*")

    # How many terms a source has with each count; the share stands for the count.
    levels = shares.groupBy("lang", "s", "z", "p").agg(F.count(F.lit(1)).alias("m"))
    other = sized.select("lang", F.col("s").alias("t"), F.col("z").alias("zt"))
    p, z, zt, m, s, t = (F.col(x) for x in ("p", "z", "zt", "m", "s", "t"))
    one = F.array(
        F.struct(s.alias("a"), t.alias("b"), (m * (gain(p, zt) - gain(z, zt))).alias("value")),
        F.struct(t.alias("a"), s.alias("b"), (m * (gain(zt, p) - gain(zt, z))).alias("value")),
    )
    either = levels.join(other, "lang").where(s != t).select("lang", F.inline(one))

    pair = groups.select("lang", "s", "z", "kept").join(other, "lang").where(s != t)
    none = pair.select("lang", s.alias("a"), t.alias("b"), F.when(F.col("kept") > 0, F.col("kept") * gain(z, zt)).otherwise(0).alias("value"))
    # Sums over both come first, so that what other sources add does not wait on them.
    value = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    value = value.unionByName(either).unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = sized.select("lang", F.col("s").alias("a"), "source")
    items = sized.select("lang", F.col("s").alias("b"), F.col("source").alias("item"))
    named = value.join(names, ["lang", "a"]).join(items, ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)


def _both(a: Column, b: Column) -> Column:
    value = gain(a["p"], b["p"]) - gain(a["p"], b["z"]) - gain(a["z"], b["p"]) + gain(a["z"], b["z"])
    return F.struct(a["s"].alias("a"), b["s"].alias("b"), value.alias("value"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(whole) AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p, 1 + 1000000000::HUGEINT * (whole + 1) // (lang_total + v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(f) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT u.lang, u.source, o.source AS other, sum((u.p - o.p) * (u.p - o.p) // o.p) AS f FROM p u JOIN p o ON u.lang = o.lang AND u.term = o.term AND u.source <> o.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(coalesce(value, 0) AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY coalesce(value, 0) DESC, item) AS INTEGER) AS rank FROM x QUALIFY part = 'pair' OR rank <= 200
"""
