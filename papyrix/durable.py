"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one, else that of ``setCheckpointDir``.

    A session that has neither gets a local one if it runs on this machine alone, as in tests, and an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="papyrix-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of ``path``: (file system, path)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def state_of(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: names, lengths and times of a file or of all files below a folder."""
    fs, where = file_system(spark, path)
    files, found = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


class Scratch:
    """Tables written below the shared folder, so that lineage is cut and lost executors cost no recomputation.

    Unlike RDD checkpoints these are columnar, compressed and computed once. ``drop`` removes a table that no later plan
    reads; what is left goes when the driver process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._clear)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` as ``table`` and return it as read back, with the same schema."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        delete(self.spark, self.path(table))

    def _clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete(self.spark, self.root)
        except Exception:  # the session has already ended; the folder is then the cluster's to clean
            pass
