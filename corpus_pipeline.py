"""Corpus preparation in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all
but the last return the columns of ``documents``.  ``run`` writes what a stage keeps as Parquet into the shared
folder and reads it back as the next stage's input, so a lost executor repeats work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, packing, pii, quality, simhash
from quillspark.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below the threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float | None = 0.8) -> DataFrame:
    """One document of each near-duplicate group stays: of op5's groups, widened by that similarity of 5-word shingle sets."""
    return simhash.drop_near_duplicates(docs, similarity)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of full training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_classifier),
    ("simhash", near_duplicates),
    ("decontam", decontamination),
    ("pii", redaction),
    ("packing", packed),
]
# models, fingerprints and tokenizers are not SQL; tests set the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
