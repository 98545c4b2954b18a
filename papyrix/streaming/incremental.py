"""Digest files as they arrive: a file stream through the whole write path, searchable batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import digest, documents

#: How long the stream remembers an id, by the times of files.
EXPIRY = "30 days"


def arriving_texts(spark: SparkSession, folder: str) -> DataFrame:
    """New text files below ``folder`` as raw documents, with the time of the file (arrived)."""
    lines = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    file = F.col("_metadata.file_path")
    none = F.lit(None).cast("string")
    return lines.select(file.alias("file"), file.alias("native_key"), text.filename_title(file).alias("title"), none.alias("author"), none.alias("url"), F.lit(None).cast("timestamp").alias("published"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def once(made: DataFrame, expiry: str = EXPIRY) -> DataFrame:
    """Documents of a stream, each id once; ids older than ``expiry`` leave the state, so it does not grow with the stream."""
    return made.withWatermark("arrived", expiry).dropDuplicatesWithinWatermark(["id"]).drop("arrived")


def digest_stream(spark: SparkSession, folder: str, source: str, base: str, checkpoint: str, embedder: digest.Embedder | None = None, expiry: str = EXPIRY) -> StreamingQuery:
    """Digest arriving files into ``source`` of the store at ``base``: each micro-batch is a version of its own, committed as one.

    A batch that fails before its commit leaves the store as it was and is run again; one that had been committed is passed over, by
    the stream's id and the batch's number in the store's state. ``digest.compact`` makes one version of many.
    """
    made = once(documents.build(arriving_texts(spark, folder), source, "text", keep=("arrived",)), expiry)

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        digest.append_batch(session, base, source, batch, session.sparkContext.getLocalProperty("sql.streaming.queryId"), number, embedder)

    return made.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
