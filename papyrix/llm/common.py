"""Session preparation and durable intermediate tables shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import Scratch, shared_dir

__all__ = ["Scratch", "prepare", "row_digest", "shared_dir", "table"]

#: Rows per Arrow batch handed to Python: texts may be very long, so batches stay small in bytes.
ARROW_ROWS = "512"
ARROW_BYTES = "16777216"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the Arrow batch bounds that keep Python workers small, and return the session. Results are computed after the
    operators return, so the bounds stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_digest(*columns) -> F.Column:
    """SHA-256 of the values of ``columns``: equal for rows alike in all of them, nulls apart from any value. Each value has its
    length before it, so that no two rows run into the same bytes."""
    value = lambda c: c.cast("string").cast("binary")
    parts = [F.coalesce(F.concat(F.octet_length(value(c)).cast("string").cast("binary"), F.lit(b":"), value(c)), F.lit(b"-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)
