"""The log of a store: numbered states, each a file that is created once, on any file system Spark reaches.

A writer puts the next number beside the last one it has read. If another writer was first, that number exists, nothing is
written, and the writer reads again and decides anew. So states follow each other without a gap, and a reader holds one.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

from .. import durable

FOLDER = "_log"


def _local(base: str) -> str | None:
    """The path of a folder of this machine's file system, else None."""
    if base.startswith("file:"):
        return re.sub("^file:/*", "/", base)
    return None if "://" in base else base


def _hadoop(base: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{base} can be reached with a Spark session only")
    return spark, *durable.file_system(spark, f"{base.rstrip('/')}/{FOLDER}")


def _name(number: int) -> str:
    return f"{number:020d}.yaml"


def states(base: str) -> list[int]:
    """The numbers of the log, ascending."""
    local = _local(base)
    if local is not None:
        folder = os.path.join(local, FOLDER)
        names = os.listdir(folder) if os.path.isdir(folder) else []
    else:
        _, fs, folder = _hadoop(base)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{20})\.yaml", n)))


def read(base: str, number: int) -> str:
    local = _local(base)
    if local is not None:
        with open(os.path.join(local, FOLDER, _name(number)), encoding="utf-8") as f:
            return f.read()
    spark, fs, folder = _hadoop(base)
    stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, _name(number)))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(base: str, number: int, content: str) -> bool:
    """Put ``content`` into the log as ``number``, whole or not at all; False if that number exists."""
    local, own = _local(base), f".{uuid.uuid4().hex}"
    if local is not None:
        folder = os.path.join(local, FOLDER)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, own), "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(os.path.join(folder, own), os.path.join(folder, _name(number)))  # fails if it is there
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(os.path.join(folder, own))
    spark, fs, folder = _hadoop(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(folder)
    stream = fs.create(path(folder, own), True)
    stream.write(bytearray(content.encode()))
    stream.close()
    target = path(folder, _name(number))
    # A rename onto a file fails on distributed file systems; the look before is for those that replace it.
    done = not fs.exists(target) and fs.rename(path(folder, own), target)
    if not done:
        fs.delete(path(folder, own), False)
    return bool(done)
