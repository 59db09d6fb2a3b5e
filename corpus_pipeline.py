"""A training-data pipeline: quality, near copies, secrets, source mix and packing, each stage on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm import dedup, mixing, packing, quality, secret_scan
from trialforge.llm.common import mark, settle, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as label 1; fitted on the labelled rows that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, quality.train(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return dedup.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials masked in their texts."""
    return secret_scan.remove_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of up to 1024 tokens."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: the classifier, the groups of near copies and the tokens are beyond it. tests/llm tests it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, with a written table between each two; what a stage wrote besides
    is deleted once its table is there, and so is the table before."""
    docs, before = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), before)
    return STAGES[-1][1](spark, docs, sf_dir)
