"""Corpus statistics: counts, exact spreads, years and vocabulary, by source and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import Scratch
from ..functions import text

ALL = "all"
#: Ranges of values that a source is dealt into.
RANGES = 1000


def _label() -> F.Column:
    return F.when(F.grouping("source") == 1, ALL).otherwise(F.col("source")).alias("source")


def by_source(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents, chunks, words, undated, empty, earliest and latest of each source and of all."""
    n = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    rows = documents.select("id", "source", "words", "published").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.rollup("source").agg(
        F.grouping("source").alias("g"), F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.sum("words").alias("words"), F.count_if(F.col("published").isNull()).alias("undated"), F.count_if(F.col("n") == 0).alias("empty"),
        F.min("published").alias("earliest"), F.max("published").alias("latest"),
    )
    return out.select(F.when(F.col("g") == 1, ALL).otherwise(F.col("source")).alias("source"), "documents", "chunks", "words", "undated", "empty", "earliest", "latest")


def spread(values: DataFrame, column: str) -> DataFrame:
    """min, p50, p90, p99, max and whole mean of a column (small integers) by source and over all.

    Exact: values are counted first, and the p-th percentile is the value at the 0-based place n * p div 100 of the sorted
    values, the least one with more values up to it.
    """
    # Stored, as everything below starts from it and would read the values anew.
    kinds = Scratch(values.sparkSession, "spread").keep(values.groupBy("source", F.col(column).cast("long").alias("v")).agg(F.count("*").alias("n")), "kinds")
    kinds = kinds.unionByName(kinds.withColumn("source", F.lit(ALL)).groupBy("source", "v").agg(F.sum("n").alias("n")))
    # A source's distinct values are dealt into ranges; only ranges are walked, each from the count of those before it.
    total = kinds.groupBy("source").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sum("n").alias("total"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    width = F.greatest(F.lit(1), F.call_function("div", F.col("max") - F.col("min"), F.lit(RANGES)) + 1)
    rows = kinds.join(total, "source").withColumn("range", F.call_function("div", F.col("v") - F.col("min"), width))
    sizes = rows.groupBy("source", "range").agg(F.sum("n").alias("held"))  # at most RANGES + 1 a source
    before = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("source", "range", before.alias("before")), ["source", "range"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source", "range").orderBy("v"))
    rows = rows.withColumn("upto", upto)

    def at(p: int) -> F.Column:
        place = F.call_function("div", F.col("total") * p, F.lit(100))
        return F.min(F.when(F.col("upto") > place, F.col("v"))).alias(f"p{p}")

    found = rows.groupBy("source", "min", "max", "total", "sum").agg(at(50), at(90), at(99))
    return found.select("source", "min", "p50", "p90", "p99", "max", F.call_function("div", F.col("sum"), F.col("total")).alias("mean"))


def years(documents: DataFrame) -> DataFrame:
    """Dated documents by year, of each source and of all."""
    rows = documents.filter("published is not null").groupBy("source", F.year("published").alias("year")).agg(F.count("*").alias("documents"))
    return rows.unionByName(rows.groupBy(F.lit(ALL).alias("source"), "year").agg(F.sum("documents").alias("documents"))).orderBy("source", "year")


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Distinct terms of passages and terms met once, of each source and of all."""
    terms = chunks.select("source", F.explode(text.search_tokens(F.col("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    whole = terms.groupBy("term").agg(F.sum("n").alias("n"))
    count = [F.count("*").alias("vocabulary"), F.count_if(F.col("n") == 1).alias("hapax")]
    return terms.groupBy("source").agg(*count).unionByName(whole.agg(*count).select(F.lit(ALL).alias("source"), "vocabulary", "hapax"))
