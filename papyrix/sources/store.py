"""The digested store: Parquet tables by source and version, and the vector file for interchange.

A digest claims a new version of a source, writes its tables, and commits a state of the store's log that names the version. So a
reader never sees half a source, a digest that dies leaves the one before, and digests at once do not write to one place.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import durable
from . import log, manifests

TABLES = ("documents", "chunks", "vectors", "postings", "terms")
#: How rows are ordered within files, so that a reader of few keys passes over row groups.
ORDER = {"documents": ["id"], "chunks": ["doc_id", "index"], "vectors": ["chunk_id"], "postings": ["term", "slot"], "terms": ["term"]}
#: Fixed value: how a vector file begins.
MAGIC = b"CORVEC1\0"
WIDEST = 65536


def path(base: str, name: str, source: str, version: int) -> str:
    return f"{base.rstrip('/')}/{name}/source={source}/version={version}"


def write(spark: SparkSession, base: str, source: str, version: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """Write ``version`` of a source's tables, and return them as read back. They count once the manifest names the version.

    Blocks of postings are dealt out by ranges of (term, slot): a query's terms are in few files, a frequent term in several.
    """
    out = {}
    for name in TABLES:
        rows = tables[name].drop("source")
        rows = rows.repartitionByRange(*ORDER[name]) if name == "postings" else rows
        rows.sortWithinPartitions(*ORDER[name]).write.mode("overwrite").parquet(path(base, name, source, version))
        out[name] = spark.read.schema(rows.schema).parquet(path(base, name, source, version)).withColumn("source", F.lit(source))
    return out


def claim(spark: SparkSession, base: str, source: str, after: int) -> int:
    """A version of ``source`` above ``after`` that no other digest has claimed: its folder is made by one of them only."""
    fs, folder = durable.file_system(spark, f"{base.rstrip('/')}/documents/source={source}")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    version = max([after, *(int(n.split("=")[1]) for n in names if n.startswith("version="))]) + 1
    while not log.create(f"{base.rstrip('/')}/{log.FOLDER}/claims/{source}", version, ""):
        version += 1
    return version


def read(spark: SparkSession, base: str, name: str, source: str | None = None, at: int | None = None) -> DataFrame | None:
    """A table of the store, of one source (its files alone are read) or all, in its last state or the one numbered ``at``; None if
    there is none. Tables that the state names and that cannot be read are an error."""
    held = manifests.load_store_manifest(base, at).entries(source)
    paths = [path(base, name, s.name, v) for s in held for v in s.versions]
    if not paths:
        return None
    return spark.read.option("basePath", f"{base.rstrip('/')}/{name}").parquet(*paths).drop("version")


def remove_older(spark: SparkSession, base: str, source: str, version: int) -> None:
    """Delete the versions of a source before ``version``; later ones may be being written. States that name them cannot be read then."""
    for name in TABLES:
        fs, folder = durable.file_system(spark, f"{base.rstrip('/')}/{name}/source={source}")
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                folder_name = status.getPath().getName()
                if folder_name.startswith("version=") and int(folder_name.split("=")[1]) < version:
                    fs.delete(status.getPath(), True)


def check(chunks: DataFrame, vectors: DataFrame) -> None:
    """Every passage has a vector and all vectors have one width."""
    lost = chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti").limit(1).count()
    widths = vectors.agg(F.countDistinct(F.size("embedding")).alias("n")).first().n
    if lost or widths > 1:
        raise ValueError("passages and vectors of the store do not fit together")


def pack_vectors(vectors: np.ndarray) -> bytes:
    """Rows of equal width as a vector file: header, dimensions, count, little-endian floats."""
    v = np.asarray(vectors, "<f4")
    if v.ndim != 2 or v.shape[1] > WIDEST:
        raise ValueError("vectors must be rows of one width")
    return MAGIC + struct.pack("<II", v.shape[1], v.shape[0]) + v.tobytes()


def vector_dims(head: bytes) -> tuple[int, int]:
    if head[:8] != MAGIC or len(head) < 16:
        raise ValueError("not a vector file")
    dims, count = struct.unpack_from("<II", head, 8)
    if dims > WIDEST:
        raise ValueError("vectors too wide")
    return dims, count


def unpack_vectors(blob: bytes) -> np.ndarray:
    dims, count = vector_dims(blob)
    if len(blob) != 16 + 4 * dims * count:
        raise ValueError("a vector file of the wrong length")
    return np.frombuffer(blob, "<f4", dims * count, 16).reshape(count, dims)
