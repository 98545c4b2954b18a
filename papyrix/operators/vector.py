"""Unit vectors and the exact cosine scan, of one query or of a table of them."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import HELD, ORDER, Best, top, top_each

#: Bytes of the query vectors of one round, which are sent to all tasks.
ROUND_BYTES = 1 << 23
#: Scores that a task holds at a time.
SCORES = 1 << 21
#: Queries that are scored together, so that their sums stay near the processor, and pairs that are scored one by one.
TILE, PAIRS = 1 << 10, 1 << 14


def unit(vector: Column) -> Column:
    """The vector at length 1: squares summed in double, scaled as float; a zero vector stays."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    scale = (1 / F.sqrt(squares)).cast("float")
    return F.when(squares == 0, vector).otherwise(F.transform(vector, lambda x: (x * scale).cast("float")))


def unit_list(vector: list[float]) -> list[float]:
    """``unit`` for a query on the driver, with single-precision results."""
    norm = math.sqrt(sum(x * x for x in vector))
    return [struct.unpack("f", struct.pack("f", x / norm))[0] for x in vector] if norm else list(vector)


def dots(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Single-precision dot products of all rows with all queries, each summed from the first entry to the last."""
    out, columns = np.zeros((len(rows), len(queries)), np.float32), np.ascontiguousarray(queries.T)
    part = np.empty((len(rows), min(TILE, len(queries))), np.float32)
    for at in range(0, len(queries), TILE):
        some = out[:, at : at + TILE]
        here = part[:, : some.shape[1]]
        for d in range(rows.shape[1]):
            np.multiply(rows[:, d, None], columns[None, d, at : at + TILE], out=here)
            some += here
    return out


def _candidates(rows: np.ndarray, queries: np.ndarray, margin: np.float32, best: Best, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the best, by a product of matrices whose sums (in ``near``) are in any order: off from
    ``dots`` by at most ``margin``."""
    with np.errstate(invalid="ignore"):
        np.matmul(queries, rows.T, out=near)
        hits = near >= (best.least - margin)[:, None]
        if len(rows) > best.limit and np.count_nonzero(hits) > best.limit * len(queries):
            # The k-th of these sums, less the margin, is no more than the k-th score.
            kth = np.partition(np.where(np.isnan(near), -np.inf, near), len(rows) - best.limit, axis=1)[:, len(rows) - best.limit]
            np.maximum(best.least, kth - margin, out=best.least)
            hits = near >= (best.least - margin)[:, None]
    return np.divmod(np.flatnonzero(hits), len(rows))


def _scan(queries: np.ndarray, limit: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(queries), limit, np.float32(-np.inf)), max(1, SCORES // len(queries))
        near, longest = np.empty(step * len(queries), np.float32), np.sqrt((queries.astype(np.float64) ** 2).sum(1).max())
        for batch in batches:
            rows = np.asarray(batch.column(3).flatten(), np.float32).reshape(batch.num_rows, queries.shape[1])
            where = pa.table({name: batch.column(i) for i, name in enumerate(ORDER)})
            # Either sum is off by a rounding at each of its steps; long rows, whose sums might overflow, are not looked at so.
            length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
            margin = 2.2 * (rows.shape[1] + 4) * 2.0**-24 * longest * length + 1e-37
            plain = length * longest < 1e18
            for some, exact in ((np.flatnonzero(plain), False), (np.flatnonzero(~plain), True)):
                for at in range(0, len(some), step):
                    here = some[at : at + step]
                    if exact:
                        scores = dots(rows[here], queries)
                        p, q = np.nonzero(scores >= best.least)
                        score = scores[p, q]
                    else:
                        q, p = _candidates(rows[here], queries, np.float32(margin[here].max()), best, near[: len(here) * len(queries)].reshape(len(queries), -1))
                        score = _dots_of(rows[here], queries, p, q)
                        good = score >= best.least[q]
                        q, p, score = q[good], p[good], score[good]
                    best.add(q, score, here[p], where)
        for found in best.tables():
            yield from pa.Table.from_arrays([found.column(i).cast(f.type) for i, f in enumerate(schema)], schema=schema).combine_chunks().to_batches()

    return run


def _dots_of(rows: np.ndarray, queries: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``dots`` of the pairs of row p and query q alone, with the same bits."""
    out = np.zeros(len(p), np.float32)
    for at in range(0, len(p), PAIRS):
        some, x, y = out[at : at + PAIRS], rows[p[at : at + PAIRS]].T, queries[q[at : at + PAIRS]].T
        for d in range(rows.shape[1]):
            some += x[d] * y[d]
    return out


def _scanned(vectors: DataFrame, queries: np.ndarray, limit: int) -> DataFrame:
    """Per task the nearest ``limit`` of ``vectors`` to each query: its number, source, doc_id, index, score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import FloatType, LongType, StructField, StructType

    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = vectors.filter((F.size("embedding") == queries.shape[1]) & whole).select(*ORDER, F.col("embedding").cast("array<float>").alias("embedding"))
    schema = StructType([StructField("query", LongType()), *rows.select(*ORDER).schema.fields, StructField("score", FloatType())])
    return rows.mapInArrow(_scan(queries, limit, to_arrow_schema(schema)), schema)


def cosine_top(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """The nearest ``limit`` passages of ``vectors`` (source, doc_id, index, embedding), any sign of score, with rank.

    Missing vectors, vectors of another width and those with a missing entry are passed over.
    """
    return top(_scanned(vectors, np.array([unit_list(query)], np.float32), max(limit, 1)).drop("query"), limit)


def cosine_many(vectors: DataFrame, queries: DataFrame, limit: int, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``cosine_top`` of each of ``queries`` (query_id, embedding), a table of any size: query_id, source, doc_id, index, score, rank.

    Queries go to the tasks in rounds of ``round_bytes``, or as many as have HELD hits, a round as one matrix against batches of vectors;
    a task gives the best ``limit`` of what it has seen. Queries without a vector find nothing; those of another width than the first are an error.
    Ids are unique and not null.
    """
    asking = queries.filter("query_id is not null and size(embedding) > 0").select("query_id", unit(F.col("embedding").cast("array<float>")).alias("embedding"))
    widths = asking.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.count("*").alias("n")).first()
    if widths.least != widths.most:
        raise ValueError("query vectors of several widths")
    none = vectors.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *ORDER, F.lit(0.0).cast("float").alias("score")).limit(0)
    # Each vector costs as many products as there are queries, so few bytes are much work: every core gets its share of them.
    dealt = vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    found, rounds = None, max(-(-widths.n * 4 * (widths.most or 0) // round_bytes), -(-widths.n * limit // HELD))
    for number in range(rounds):
        here = asking.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == number).toArrow()  # a round's bytes, about
        if here.num_rows:
            names = vectors.sparkSession.createDataFrame(pa.table({"query": pa.array(np.arange(here.num_rows)), "query_id": here.column("query_id")}))
            asked = np.asarray(here.column("embedding").combine_chunks().flatten(), np.float32).reshape(here.num_rows, -1)
            got = _scanned(dealt, asked, limit).join(F.broadcast(names), "query").select("query_id", *ORDER, "score")
            found = got if found is None else found.union(got)
    return top_each(none if found is None else found, limit)
