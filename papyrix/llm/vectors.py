"""Vectors of floating-point numbers as vectors of whole numbers: what takes part, scaling, padding and matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers up to this are exact as doubles; scaled entries must be.
EXACT = 2**53


def whole(rows: DataFrame, vector: str, scale: int, *columns) -> DataFrame:
    """``columns`` of the rows whose ``vector`` takes part, and x: floor(scale * entry) of each entry as a long.

    A vector that is null or holds a null, a NaN or an infinity takes no part. Shorter vectors are filled up with zeros to
    the length of the longest. An entry whose scaled value is beyond 2^53 is an error, for it is no exact whole number.
    """
    entry = F.col(vector)
    finite = F.coalesce(F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    scaled = lambda c: c.cast("double") * scale
    x = F.transform(entry, lambda c: F.when(F.abs(scaled(c)) <= EXACT, F.floor(scaled(c))).otherwise(F.raise_error(F.lit("a scaled entry is beyond 2^53")).cast("long")))
    out = rows.filter(finite).select(*columns, x.alias("x"))
    size = out.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size.least == size.most:
        return out
    return out.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size.most) - F.size("x"))))


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of one length in ``column`` as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0), np.int64)
