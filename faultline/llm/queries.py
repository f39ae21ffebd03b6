"""One query per corpus operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import (bm25, decontaminate, hard_negatives, html_text, line_dedup, packing, secrets, simhash, spelling, substring_dedup,
                           token_store, toxicity, url_filter)
from faultline.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-line chunks that occur more than once in ``documents``, removed."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of ``documents`` placed in sequences of 1024."""
    return packing.report(table(spark, sf_dir, "documents"))


def op3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20."""
    return bm25.report(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token ids, written to the shared folder and read back."""
    return token_store.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and the components of those within two bits."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.report(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, fitted on labelled documents outside the held-out fold."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents searched for passages of ``benchmark``."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 35-word windows that occur more than once in ``documents``."""
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of nested host and path rules on the url of every page."""
    return url_filter.report(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` with their near words, frequent forms and roots."""
    return spelling.report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every row of ``embeddings`` whose id is divisible by 50."""
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_packing, op3_bm25, op4_token_store, op5_simhash, op6_html_text, op7_toxicity,
    op8_decontaminate, op9_secrets, op10_substring_dedup, op11_url_filter, op12_spelling_variants, op13_hard_negatives)}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op11_url_filter": url_filter.ORACLE}
