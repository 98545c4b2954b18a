"""The corpus pipeline: quality rules, quality classifier, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents.

Null and empty texts fail the base rules and go in the first stage. Rows that repeat a doc_id and text are one copy in the third.
Of equal texts the least doc_id stays, of near duplicates the least of their component; null ids count as largest and are near
duplicates of nothing. Texts of any length are taken whole, extra columns are carried along, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrix.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules
from papyrix.llm.common import Scratch, table


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    return quality_rules.drop_rejected(docs)


def keep_by_score(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above the score quantile of a ranker fitted on the labelled ones among them."""
    return quality_classifier.drop_poor(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, at the similarity of 0.8 of near-duplicate stages."""
    return near_dedup.drop_near_copies(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of full sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_score),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_near_copy),
    ("packing", pack),
]

#: SQL has neither the tokeniser nor the search, so the pipeline is held against brute force in its tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder before the next reads them."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
