"""The synthetic Parquet tables as the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def corpus(spark: SparkSession, base: str, tidied: bool = True) -> DataFrame:
    """``documents`` as documents: the id is doc_id as text, dates run ten characters a day from 2020 on. Duplicate detection finds the
    same words in texts that are not ``tidied``."""
    day = F.expr("timestamp_seconds(1577836800 + (n_chars div 10) * 86400)")
    body = text.tidy(F.col("text"))
    rows = table(spark, base, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.lit("table").alias("source_type"), F.lit("").alias("title"), F.lit("").alias("url"), day.alias("published"), (body if tidied else F.col("text")).alias("text"))
    words = text.word_count(F.col("text") if tidied else text.tidy(F.col("text")))
    return rows.withColumn("words", words).withColumn("quote", F.lit(False))


def passages(spark: SparkSession, base: str) -> DataFrame:
    """One passage a line that is not empty: source, doc_id, index (the line's number), text and what retrievers index."""
    rows = table(spark, base, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text")).filter("text <> ''")
    return rows.withColumn("indexed", text.indexed_text(F.lit(""), F.col("text")))


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of first passages, by vec_id = doc_id; documents without one are absent."""
    rows = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows.join(table(spark, base, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", F.lit(0).alias("index"), "embedding")


def events(spark: SparkSession, base: str) -> DataFrame:
    """``events`` with times in UTC, which the files leave without a zone."""
    return table(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))
