"""From raw documents to byte-pair encoded ones: five stages, each over all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import op02_mix, op06_exact, op07_quality, op08_jaccard, op10_bpe
from voxloom.llm.common import stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own quality weight is under the threshold go."""
    return op07_quality.accept(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return op06_exact.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return op08_jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at its share; a document comes as often as it is taken."""
    return op02_mix.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-pair ids and digests of each document."""
    return op10_bpe.bpe_report(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing sources to target weights", mixed), ("byte-level BPE encoding and decoding", encoded)]

#: The quality model and the draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
