"""Registered queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontam, licenses, packing, pii, quality, repair, rules, runindex, secrets, sharding, simhash, tokens
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.repeats(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_decontam": op4_decontam,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_tokens": op8_tokens,
    "op9_rules": op9_rules,
    "op10_pii": op10_pii,
    "op11_runindex": op11_runindex,
    "op12_repair": op12_repair,
    "op13_alignment": op13_alignment,
}
ORACLES = {
    "op3_licenses": licenses.oracle_sql(),
    "op4_decontam": decontam.ORACLE_SQL,
    "op7_sharding": sharding.ORACLE_SQL,
    "op9_rules": rules.ORACLE_SQL,
    "op11_runindex": runindex.ORACLE_SQL,
}
