"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, divergence, fim, hnsw, language, licenses, mixing, quality, records, secrets, simhash, tokens, warc
from siltstone.llm._common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_license_scan(spark, sf_dir):
    return licenses.license_summary(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secrets.secret_summary(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nearest(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_token_records(spark, sf_dir):
    return records.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_source_audit(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def base_licenses(spark, sf_dir):
    """What of op1_license_scan SQL can express: the phrases that are counted at every place."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_LICENSES = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (SELECT * FROM (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])) AS v(label, words)),
h AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, label, words, unnest(range(0, len(w))) AS i FROM d JOIN p ON list_has_all(w, words))
  WHERE w[i + 1:i + len(words)] = words
), g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""


def base_secrets(spark, sf_dir):
    """What of op5_secret_scan SQL can express: how many base secrets of each kind a text has."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE_SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda v: length(v) >= 16)) AS n_hex FROM d
"""


def mix_targets(spark, sf_dir):
    """What of op4_mixing SQL can express: sizes and targets."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


MIX_TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, 3.0 * size / weight AS full_at, coalesce(sum(3 * size) OVER f, 0) AS given, coalesce(sum(weight) OVER f, 0) AS gone, sum(size) OVER () AS words, sum(weight) OVER () AS weights
      FROM w WINDOW f AS (ORDER BY 3.0 * size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- Sources fill up in the order of full_at; the level stands where the next one does not.
l AS (SELECT min((words - given) / (weights - gone)) AS level FROM (SELECT *, row_number() OVER (ORDER BY full_at, place) AS r FROM o WHERE (words - given) / (weights - gone) <= full_at QUALIFY r = 1))
SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(o.size AS BIGINT) AS source_size, round(CAST(least(3.0 * o.size, weight * level) AS DOUBLE), 4) AS target
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_token_counts,
        op3_simhash,
        op4_mixing,
        op5_secret_scan,
        op6_quality,
        op7_decontaminate,
        op8_nearest,
        op9_language,
        op10_warc,
        op11_fill_in_middle,
        op12_token_records,
        op13_source_audit,
        base_licenses,
        base_secrets,
        mix_targets,
    )
}
SQL = {
    "op7_decontaminate": decontaminate.SQL, "op10_warc": warc.SQL, "op11_fill_in_middle": fim.SQL, "op13_source_audit": divergence.SQL, "base_licenses": BASE_LICENSES, "base_secrets": BASE_SECRETS, "mix_targets": MIX_TARGETS,
}
