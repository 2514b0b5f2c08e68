"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .op01_spans import removed_ranges
from .op02_mix import mix_report
from .op03_ctw import score
from .op04_ids import ids_report
from .op05_topk import search
from .op06_exact import dedup_report
from .op07_quality import quota_sample
from .op08_jaccard import near_report
from .op09_urls import filter_urls, rule_table
from .op10_bpe import bpe_report
from .op11_trie import trie_report
from .op12_licenses import scan
from .op13_negatives import mine, shifted_labels


def op1_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_ranges(table(spark, sf_dir, "documents"), both_ends=True)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op4_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_report(table(spark, sf_dir, "documents"))


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op7_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(table(spark, sf_dir, "conversations"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(shifted_labels(table(spark, sf_dir, "embeddings")))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_repeated_spans, op2_mix_sources, op3_context_tree, op4_simple8b_ids, op5_top_products,
                            op6_exact_dedup, op7_quality_sample, op8_near_copies, op9_url_filter, op10_byte_bpe, op11_prefix_trie,
                            op12_licenses, op13_hard_negatives)}
