"""Snapshot diff of sources against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("added", "updated", "unchanged", "removed")


def changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, digest, status) by one full outer join of (source, digest) tables; digest is null when removed."""
    old = manifest.select("source", F.col("digest").alias("old"))
    both = current.select("source", "digest", F.lit(True).alias("here")).join(old.withColumn("known", F.lit(True)), "source", "full_outer")
    status = (
        F.when(F.col("here").isNull(), "removed").when(F.col("known").isNull(), "added")
        .when(F.col("digest").eqNullSafe(F.col("old")), "unchanged").otherwise("updated")
    )
    return both.select("source", "digest", status.alias("status"))


def summary(diff: DataFrame, total_chunks: int | DataFrame) -> DataFrame:
    """One row: added, updated, unchanged, removed, total_chunks."""
    counts = diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES])
    if isinstance(total_chunks, DataFrame):
        # two one-row tables
        return counts.crossJoin(total_chunks.agg(F.count("*").alias("total_chunks")))
    return counts.withColumn("total_chunks", F.lit(total_chunks).cast("long"))


def retained(records: DataFrame, diff: DataFrame) -> DataFrame:
    """Records of sources that are neither changed nor removed."""
    return records.join(diff.where(F.col("status").isin("updated", "removed")).select("source"), "source", "left_anti")


def log_lines(diff: DataFrame, per_source: DataFrame) -> DataFrame:
    """What a verbose sync prints for each changed source."""
    counts = diff.where("status <> 'unchanged'").join(per_source, "source", "left")
    n = F.coalesce("n_chunks", F.lit(0)).cast("string")
    changed = F.concat(F.lit("[sync] "), F.initcap("status"), F.lit(": "), F.col("source"), F.lit(" ("), n, F.lit(" chunks)"))
    gone = F.concat(F.lit("[sync] Removed (deleted from disk): "), F.col("source"))
    return counts.select("source", F.when(F.col("status") == "removed", gone).otherwise(changed).alias("line"))
