"""The folded timeline: copies under their winners, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def entries(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Documents that are no folded copy, each with the number of its copies. ``members`` is a stored table."""
    lost = members.filter("not winner")
    folded = lost.groupBy(F.col("winner_id").alias("id")).agg(F.count("*").alias("copies"))
    kept = documents.join(lost.select("id"), "id", "left_anti").join(folded, "id", "left")
    return kept.select("id", "source", F.col("source_type").alias("type"), "title", "url", "published", "words", "text", text.length_class(F.col("words")).alias("length"), "quote", F.coalesce("copies", F.lit(0)).alias("copies"))


def copies(documents: DataFrame, members: DataFrame) -> DataFrame:
    """The folded copies, a row each: winner_id, id, source, title, url, published, score."""
    lost = members.filter("not winner").select("id", "winner_id", "score")
    return lost.join(documents.select("id", "source", "title", "url", "published"), "id").select("winner_id", "id", "source", "title", "url", "published", "score")


def lines(rows: DataFrame, folded: DataFrame, entry, copy, undated_last: bool = True) -> DataFrame:
    """Entries and their copies in the order of a timeline, each copy below its entry, best score first, then by source and id:
    (kind, published, body), kind being ``entry`` or ``copy``, published the entry's, and body the column given for either.

    One sort of all rows: an entry with any number of copies is spread over ranges like the rest.
    """
    head = [F.col("published").alias("at"), F.col("source").alias("of"), F.col("id").alias("entry_id")]
    none = F.lit(None).cast("double")
    mine = rows.select(*head, F.lit("entry").alias("kind"), none.alias("less"), F.lit("").alias("source"), F.lit("").alias("id"), entry.alias("body"))
    theirs = folded.select(F.col("winner_id").alias("entry_id"), (-F.col("score")).alias("less"), "source", "id", copy.alias("body")).join(rows.select(*head), "entry_id")
    every = mine.unionByName(theirs.withColumn("kind", F.lit("copy")).select(*mine.columns))
    when = F.col("at").desc_nulls_last() if undated_last else F.col("at").desc_nulls_first()
    return every.orderBy(when, "of", "entry_id", F.col("kind").desc(), "less", "source", "id").select("kind", F.col("at").alias("published"), "body")


def newest_first(rows: DataFrame) -> DataFrame:
    """Dated entries by date, source and id; undated ones after them."""
    return rows.orderBy(F.col("published").desc_nulls_last(), "source", "id")


def counts_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "type").agg(F.count("*").alias("entries")).orderBy("source")


def counts(rows: DataFrame) -> DataFrame:
    """Entries by length and quote, and copies folded away, in one row."""
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum("copies"), F.lit(0)).alias("folded"), *[F.count_if(F.col("length") == n).alias(n) for n in ("short", "medium", "long")], F.count_if("quote").alias("quotes"))


def months(rows: DataFrame) -> DataFrame:
    """Entries by year and month; both null for undated ones."""
    return rows.groupBy(F.year("published").alias("year"), F.month("published").alias("month")).agg(F.count("*").alias("entries")).orderBy(F.col("year").desc_nulls_last(), F.col("month").desc_nulls_last())


def filtered(rows: DataFrame, sources: list[str] | None = None, lengths: list[str] | None = None, quotes: bool | None = None, query: str = "", oldest: bool = False) -> DataFrame:
    """The viewer's filters: sources, lengths, quotes, a case-insensitive part of title or text, either order."""
    for name, allowed in (("source", sources), ("length", lengths)):
        rows = rows.filter(F.col(name).isin(allowed)) if allowed else rows
    rows = rows if quotes is None else rows.filter(F.col("quote") == quotes)
    rows = rows.filter(F.contains(F.lower(F.concat("title", F.lit("\n"), "text")), F.lower(F.lit(query)))) if query else rows
    return rows.orderBy(F.col("published").asc_nulls_last(), "source", "id") if oldest else newest_first(rows)
