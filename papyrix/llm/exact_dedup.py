"""Operator 2: exact deduplication by skew-safe combining.

Texts are combined three times: within each map task, within salted digest groups, and over the salts' winners. Every
stage groups by digest *and* whole normalised text, so equal digests of different texts stay apart. Salts are map tasks,
not rows, so a hot text reaches a reducer as one row a task and a salt's reducer at most once a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACES = "[\\x20\\x09-\\x0D]+"
#: Salts of the middle stage. Tasks are dealt over them, so at most tasks / SALTS rows of one text meet in a salt.
SALTS = 64


def normalised(text) -> F.Column:
    """Null as empty; each run of the six ASCII white-space characters as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def group_winners(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text of ``docs`` (doc_id, text): digest, norm, keep_id, group_size."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = rows.groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any further columns) with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when their normalised forms are; null is empty. The smallest doc_id of a group stays (nulls count
    as largest); of repeated rows with that doc_id all are marked kept. Texts of any length are compared whole. A hot text
    reaches the last join as one row of its digest, against which adaptive execution splits its documents. Columns of ``docs`` that bear one of the added
    names are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    # Winners without their texts; a digest that two different texts share has two rows.
    winners = group_winners(docs, digest, salts)
    slim = scratch.keep(winners.select("digest", "keep_id", "group_size"), "winners")
    clashing = slim.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    rest = [c for c in docs.columns if c not in added]
    norm = normalised(F.col("text"))
    rows = docs.select(*rest, digest(norm).alias("__digest"), sha256(norm).alias("text_sha256"))
    if clashing.isEmpty():
        found = slim.select(F.col("digest").alias("__digest"), "keep_id", "group_size")
        joined = rows.join(found, "__digest", "left")
    else:  # compare whole texts where digests clash
        rows = rows.withColumn("__norm", norm)
        again = winners.select(F.col("digest").alias("__digest"), F.col("norm").alias("__norm"), "keep_id", "group_size")
        joined = rows.join(again, ["__digest", "__norm"], "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select(*rest, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were; of repeated rows one stays.

    Rows that share both the text group and the winning doc_id are copies of each other, so one of them is enough; it is
    the one whose columns come first as JSON, which orders columns of any type. Null ids count as one id, the largest.
    """
    marked = exact_dedup(docs).filter("kept")
    twice = marked.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1")
    if twice.isEmpty():
        return marked.select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    return marked.groupBy("doc_id", "text_sha256").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
