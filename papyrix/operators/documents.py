"""Raw documents to the canonical table: normalised, identified, flagged, one row an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quote, text


def build(raw: DataFrame, source: str | None = None, source_type: str = "", author: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents table of ``raw`` (native_key, file, title, author, url, published, text; source if not given).

    ``keep`` names further columns that stay as they are. Missing keys, titles and authors are empty strings; texts that are empty after normalisation are left out.
    """
    name = F.lit(source) if source is not None else F.col("source")
    blank = F.lit("")
    rows = raw.select(
        name.alias("source"), F.lit(source_type).alias("source_type"), F.coalesce("native_key", blank).alias("native_key"), F.coalesce("file", blank).alias("file"),
        text.normalise(F.coalesce("title", blank)).alias("title"), F.trim(F.coalesce(F.nullif(F.col("author"), blank), F.lit(author))).alias("author"), F.coalesce("url", blank).alias("url"),
        F.col("published").cast("timestamp").alias("published"), text.normalise(F.coalesce("text", blank)).alias("text"), *keep,
    ).filter("text <> ''")
    rows = rows.withColumn("content_hash", text.content_hash(F.col("text"))).withColumn("words", text.word_count(F.col("text")))
    rows = rows.withColumn("id", text.document_id(F.col("source"), F.col("native_key"), F.col("text"))).withColumn("quote", quote.quote_flag(F.col("text"), F.col("words")))
    return rows.select("id", "source", "source_type", "native_key", "file", "title", "author", "url", "published", "text", "content_hash", "words", "quote", *keep)


def unique_ids(documents: DataFrame) -> DataFrame:
    """One document an id within a source: the first by file and content hash, a total order."""
    first = Window.partitionBy("source", "id").orderBy("file", "content_hash", "title", F.col("published").asc_nulls_last())
    return documents.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def even_sample(documents: DataFrame, n: int) -> DataFrame:
    """``n`` documents at even steps in id order; all if there are fewer, none for n <= 0.

    Ranks are global, so they come from ranges of ids: each range is counted, and ranked within itself.
    """
    total = documents.count()
    if n <= 0:
        return documents.limit(0)
    if n >= total:
        return documents
    return ranked(documents, ["id"]).filter((F.col("__rank") % (total // n) == 0) & (F.call_function("div", F.col("__rank"), F.lit(total // n)) < n)).drop("__rank")


def ranked(rows: DataFrame, keys: list[str], name: str = "__rank", buckets: int = 256) -> DataFrame:
    """``rows`` with their 0-based place in the order of ``keys`` (strings in hex or longs, the first well spread).

    Rows are dealt into ranges by quantiles of the first key; a range's offset is the count of those before it, and only
    ranges are windowed, so no task sees all rows.
    """
    first = keys[0]
    cuts = rows.select(F.expr(f"percentile_approx(conv(substring({first}, 1, 12), 16, 10) + 0L, array({', '.join(str(i / buckets) for i in range(1, buckets))}), 10000)").alias("q")).first().q or []
    cuts = sorted(set(cuts))
    place = F.expr("conv(substring(" + first + ", 1, 12), 16, 10) + 0L")
    held = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    dealt = rows.withColumn("__range", F.size(F.filter(held, lambda c: c < place)))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()  # at most ``buckets`` rows
    offset, pairs = 0, []
    for r in sizes:
        pairs += [F.lit(r["__range"]), F.lit(offset).cast("long")]
        offset += r["n"]
    before = F.create_map(*pairs)[F.col("__range")] if pairs else F.lit(0)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return dealt.withColumn(name, before + within).drop("__range")
