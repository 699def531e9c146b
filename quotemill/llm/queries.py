"""The registered queries of the text operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import filter_audit, html_wrappers, license_scan, line_dedup, mixing, nearest, periodic_runs, quality, sharding, simhash, tiling, token_trie, url_filter
from quotemill.llm.common import table


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_text(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trie.token_report(spark, table(spark, sf_dir, "documents"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_wrappers,
        op2_source_mix,
        op3_simhash_pivots,
        op4_feistel_shards,
        op5_url_filter,
        op6_license_scan,
        op7_quality_rules,
        op8_line_dedup,
        op9_token_counts,
        op10_string_tiling,
        op11_filter_audit,
        op12_multi_index_hashing,
        op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": mixing.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
    "op7_quality_rules": quality.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
}
