"""Operator 13: whitening of embeddings by a tall-skinny QR factorisation (TSQR).

Distinct vectors are centred by their exact sums. Each task folds its rows into one triangular factor R, factors are merged
eight at a time until one is left, and the singular value decomposition of that one gives the eigenvectors (right vectors)
and eigenvalues of the covariance, which itself is never formed. What meets on the driver is that one factor, as wide and
high as a vector is long; a factor a task is the most that is written between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .vectors import matrix, whole

SCALE = 256
COMPONENTS = 4
#: Factors that one merging task takes.
FAN = 8

FACTOR = "part int, width int, r binary"
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs, or as Python's whole numbers where longs could overflow."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 2**63 else object
    return x.astype(kind) * n - np.array(sums, kind)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (numerators(x, n, sums) / n).astype(np.float64)


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """R of the QR factorisation of ``blocks`` on top of each other."""
    return np.linalg.qr(np.vstack(blocks), mode="r")


def _factors(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, len(sums)))
        for batch in batches:
            if batch.num_rows:
                r = triangle([r, centred(matrix(batch.column(0)), n, sums)])
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "width": pa.array([r.shape[1]], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def _unpacked(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    r = triangle([_unpacked(w, raw) for w, raw in zip(rows["width"], rows["r"])])
    return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "width": [r.shape[1]], "r": [r.tobytes()]})


def last_factor(fit: DataFrame, n: int, sums: list[int], scratch: Scratch) -> np.ndarray:
    """R of all centred rows of ``fit`` (x), merged as a tree."""
    now = scratch.keep(fit.select("x").mapInArrow(_factors(n, sums), FACTOR), "factors0")
    parts = 1 + now.agg(F.max("part")).first()[0]
    while parts > 1:
        now = now.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(_merge, FACTOR)
        parts = -(-parts // FAN)
    (last,) = now.collect()
    return _unpacked(last.width, last.r)


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the last factor: the first ``most`` eigenvectors (as rows), their eigenvalues, and their shares of the trace.

    An eigenvalue that is nothing to double precision is 0. The largest entry of a vector is positive, the first of equals."""
    width = r.shape[1]
    _, sigma, right = np.linalg.svd(r, full_matrices=True)
    sigma = np.pad(sigma, (0, width - len(sigma)))
    sigma[sigma <= sigma.max(initial=0) * width * np.finfo(float).eps] = 0
    values = sigma**2 / n
    right = right[:most] * np.sign(right[np.arange(min(most, width)), np.abs(right[:most]).argmax(1)])[:, None]
    total = values.sum()
    return right, values[:most], values[:most] / total if total else np.full(min(most, width), np.nan)


def _scores(x: np.ndarray, n: int, sums: list[int], right: np.ndarray, values: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return centred(x, n, sums) @ right.T / np.sqrt(np.where(values > 0, values, np.nan))


def _moments(n: int, sums: list[int], right: np.ndarray, values: np.ndarray):
    """Of each task: sums of the whitened columns and of their products."""
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                w = _scores(matrix(batch.column(0)), n, sums, right, values)
                total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total)), pa.int32()), "total": pa.array(total)})

    return run


def identity_error(fit: DataFrame, n: int, sums: list[int], right: np.ndarray, values: np.ndarray) -> float | None:
    """How far the covariance of the whitened fit list is from the identity: the largest absolute entry of the difference."""
    right, values = right[values > 0], values[values > 0]
    k = len(values)
    if not k:
        return None
    rows = fit.select("x").mapInArrow(_moments(n, sums, right, values), "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(k + k * k)
    for r in rows:
        total[r.place] = r.total / n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _applied(n: int, sums: list[int], right, values, explained, error):
    k = len(values)
    share = [None if np.isnan(e) else float(e) for e in explained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            far = numerators(x, n, sums)
            if far.dtype != object and far.shape[1] * int(np.abs(far).max(initial=0)) ** 2 >= 2**63:
                far = far.astype(object)
            squares = (far * far).sum(1).tolist()
            squares = [int(s) if s < 2**63 else None for s in squares]
            w = _scores(x, n, sums, right, values).ravel()
            rows = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), "n": pa.array(np.full(rows * k, n), pa.int64()),
                "deviation": pa.array([s for s in squares for _ in range(k)], pa.int64()), "whitened": pa.array(w, pa.float64(), from_pandas=True),
                "explained": pa.array(share * rows, pa.float64()), "identity_error": pa.array([error] * (rows * k), pa.float64()),
            })

    return run


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, most: int = COMPONENTS) -> DataFrame:
    """``most`` whitened components of every vector of ``rows``: see ROWS, with the share of each and the error of all.

    The fit list is each distinct vector of whole numbers once, so copies of one vector, however many, weigh as one; every row
    is returned, copies and null ids too. A vector that is null or holds null, NaN or infinity takes no part, shorter ones are
    filled up with zeros, an empty table (or one in which nothing takes part) gives no rows, and further columns are ignored.
    Vectors shorter than ``most`` have as many components as entries. Where an eigenvalue is 0 to double precision, whitened is
    null; where all are, so are explained and identity_error, which is over the components that are not. Eigenvectors
    of equal eigenvalues are any orthonormal ones. A deviation beyond a long is null.
    """
    spark = prepare(rows.sparkSession)
    scratch = Scratch(spark, "whitening")
    taking = whole(rows, vector, scale, F.col(id_column).cast("long").alias("vec_id"))
    fit = scratch.keep(taking.select("x").distinct(), "fit")
    totals = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    if not totals:
        return spark.createDataFrame([], ROWS)
    n, sums = totals[0].n, [int(t.s) for t in totals]
    right, values, explained = components(last_factor(fit, n, sums, scratch), n, most)
    error = identity_error(fit, n, sums, right, values)
    return taking.mapInArrow(_applied(n, sums, right, values, explained, error), ROWS)
