"""The report on shared links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def usable(links: DataFrame) -> DataFrame:
    return links.filter(text.usable_url(F.col("url")))


def dropped(links: DataFrame) -> DataFrame:
    """How many non-empty links are not usable."""
    return links.agg(F.count_if((F.coalesce("url", F.lit("")) != "") & ~text.usable_url(F.col("url"))).alias("dropped"))


def unique_shares(links: DataFrame) -> DataFrame:
    """One row for a URL shared several times in one second: the first by file, comment and title."""
    by = Window.partitionBy("url", F.unix_seconds("published")).orderBy("file", F.col("comment").asc_nulls_first(), F.col("title").asc_nulls_first())
    return usable(links).withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def domains(shares: DataFrame) -> DataFrame:
    """Shares by host, most first and then by name."""
    return shares.groupBy(text.host(F.col("url")).alias("domain")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "domain")


def summary(links: DataFrame) -> DataFrame:
    """One row on all extracted ``links``: shares after deduplication, distinct URLs, the span, and non-empty ones dropped."""
    none = F.lit(None).cast("timestamp")
    kept = unique_shares(links).agg(F.count("*").alias("links"), F.countDistinct("url").alias("unique"), F.min("published").alias("earliest"), F.max("published").alias("latest"))
    zero = F.lit(0).cast("long")
    rows = kept.withColumn("dropped", zero).unionByName(dropped(links).select(zero.alias("links"), zero.alias("unique"), none.alias("earliest"), none.alias("latest"), "dropped"))
    return rows.agg(F.sum("links").alias("links"), F.sum("unique").alias("unique"), F.max("earliest").alias("earliest"), F.max("latest").alias("latest"), F.sum("dropped").alias("dropped"))


def newest_first(shares: DataFrame) -> DataFrame:
    return shares.orderBy(F.col("published").desc_nulls_last(), F.col("url").desc())
