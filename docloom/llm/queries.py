"""One query per operator, over its whole table with production parameters, and DuckDB SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import CHAT_SQL, link_quotations
from .common import shared_path, table
from .decontamination import benchmark_matches
from .language import identify_language
from .packing import best_fit_packing
from .quality import QUALITY_SQL, quality_report
from .secrets import secret_report
from .simhash import simhash_components
from .substrings import SUBSTRING_SQL, substring_report
from .token_counts import token_counts
from .token_files import token_index, write_token_files


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_chat_format,
        op3_quality_rules,
        op4_language_id,
        op5_decontamination,
        op6_simhash_components,
        op7_secret_scan,
        op8_token_counts,
        op9_token_files,
        op10_best_fit_packing,
    )
}
ORACLES: dict[str, str] = {"op1_substring_dedup": SUBSTRING_SQL, "op2_chat_format": CHAT_SQL, "op3_quality_rules": QUALITY_SQL}
