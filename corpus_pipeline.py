"""A corpus pipeline of five stages: quality, near-duplicates, benchmark passages, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes what a stage returns to the
shared folder and reads it back as the next stage's documents.

All stages take null, empty and very long texts, null and repeated identifiers, rows repeated whole, and columns of any
name beside those of documents; an empty table gives no rows. What each does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, mixing, quality, secrets, simhash
from siltstone.llm._common import stage, table

#: Jaccard similarity over five-word shingles from which two documents are near-duplicates.
SHARE = 0.8


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on this input and the table of labels, rejects.

    Null and empty texts are judged like any other; equal texts share their fate. Without labels nothing is rejected.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group within op3_simhash's radius the document with the least doc_id; the stage is drop_near_copies."""
    return simhash.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: as drop_near_duplicates, where texts with SHARE of their five-word shingles in common are linked too.

    Null, empty and blank texts are one group. A document without doc_id stays only where its group has none with one; of rows equal in identifier
    and text one stays.
    """
    return simhash.keep_first(docs, share=SHARE)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of any benchmark item. Null and empty texts hold none; equal texts share their fate."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and n_chars with them; no document goes. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken (columns of these names give way).

    Null and empty texts have no words and are not taken; a null source is a source of its own; equal rows are taken as many as the mix needs.
    """
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can express neither the fitted classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"stage-{i}")
    return docs
