"""Vector files as a data source: fixed-width rows, read by ranges of bytes and written by ordered tasks.

A file is MAGIC, the width and the number of rows (little-endian 32-bit), and the rows as little-endian floats. A large table is a
folder of such files, in the order of their names; a row's number counts through all of them.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import files
from .store import MAGIC, WIDEST, vector_dims

HEAD = 16
#: Bytes of a file that one task reads, and of one Arrow batch.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SUFFIX = ".vec"


def _file(path: str, number: int) -> str:
    return f"{path}/part-{number:06d}{SUFFIX}"


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``end`` of a file, of which the table's rows before number ``before``."""

    path: str
    width: int
    first: int
    end: int
    before: int


class VectorReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self, fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [info]
        if info.type != pafs.FileType.Directory:
            raise ValueError(f"no vectors at {self.path}")
        return sorted((i for i in fs.get_file_info(pafs.FileSelector(path)) if i.base_name.endswith(SUFFIX)), key=lambda i: i.base_name)

    def partitions(self) -> list[InputPartition]:
        fs, path = files.opened(self.path)
        parts, before, widths = [], 0, set()
        for info in self._files(fs, path):
            with fs.open_input_file(info.path) as f:
                width, count = vector_dims(f.read(HEAD))
            if info.size != HEAD + 4 * width * count:
                raise ValueError(f"{info.path}: a vector file of the wrong length")
            widths |= {width} if count else set()
            step = max(1, SPLIT_BYTES // max(1, 4 * width))
            parts += [Rows(info.path, width, at, min(at + step, count), before) for at in range(0, count, step)]
            before += count
        if len(widths) > 1:
            raise ValueError(f"{self.path}: files of several widths")
        return parts or [Rows("", 0, 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        fs, _ = files.opened(self.path)
        step = max(1, BATCH_BYTES // max(1, 4 * part.width))
        for at in range(part.first, part.end, step):
            n = min(step, part.end - at)
            with fs.open_input_file(part.path) as f:
                raw = f.read_at(4 * part.width * n, HEAD + 4 * part.width * at)
            values = pa.array(np.frombuffer(raw, "<f4").astype(np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), values)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64) + part.before), lists], ["row", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    count: int
    width: int


class VectorWriter(DataSourceArrowWriter):
    """Each task streams its rows into a file of its own and puts the number of rows into its header at the end."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.own = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = files.opened(self.path)
        context = TaskContext.get()
        name = f"{path}/.{self.own}/{context.partitionId()}-{context.taskAttemptId()}"
        fs.create_dir(os.path.dirname(name), recursive=True)
        count, width = 0, 0
        with fs.open_output_stream(f"{name}.rows") as out:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("embedding"))
                sizes = set(np.diff(np.asarray(column.offsets)).tolist()) if batch.num_rows else set()
                if column.null_count or column.flatten().null_count or len(sizes | ({width} if count else set())) > 1 or any(s > WIDEST for s in sizes):
                    raise ValueError("vectors must be rows of one width, without nulls")
                if batch.num_rows:
                    width, count = sizes.pop(), count + batch.num_rows
                    out.write(np.asarray(column.flatten()).astype("<f4").tobytes())
        # Not every store lets a header be changed, so the rows follow it into the file that counts.
        with fs.open_output_stream(name) as out, fs.open_input_stream(f"{name}.rows") as rows:
            out.write(MAGIC + struct.pack("<II", width, count))
            while block := rows.read(BATCH_BYTES):
                out.write(block)
        fs.delete_file(f"{name}.rows")
        return Written(context.partitionId(), name, count, width)

    def commit(self, messages: list[Written | None]) -> None:
        """Files get their names in the order of their tasks; without rows there is one file of none."""
        fs, path = files.opened(self.path)
        kept = sorted((m for m in messages if m and m.count), key=lambda m: m.part)
        if len({m.width for m in kept}) > 1:
            self.abort(messages)
            raise ValueError("vectors must be rows of one width, without nulls")
        held = [i.path for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.base_name.endswith(SUFFIX)]
        if held and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds vectors already")
        for old in held:
            fs.delete_file(old)
        fs.create_dir(path, recursive=True)
        for number, m in enumerate(kept):
            fs.move(m.name, _file(path, number))
        if not kept:
            with fs.open_output_stream(_file(path, 0)) as out:
                out.write(MAGIC + struct.pack("<II", 0, 0))
        self._clear(fs, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*files.opened(self.path))

    def _clear(self, fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(f"{path}/.{self.own}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/.{self.own}")


class VectorSource(DataSource):
    """``format("vector_file")``: rows (row, embedding) of a file or a folder of files; written ones need an ``embedding``."""

    @classmethod
    def name(cls) -> str:
        return "vector_file"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], overwrite)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row, embedding), numbered from 0 in the order written."""
    spark.dataSource.register(VectorSource)
    return spark.read.format("vector_file").load(path)


def write_vectors(rows: DataFrame, order: list[str], path: str, parts: int | None = None) -> None:
    """The column ``embedding`` of ``rows`` as files below ``path``, in ascending ``order``, in place of what is there. ``parts`` says how
    many files at most; else there are as many as the rows fill.

    Vectors of several widths, null ones and ones with a null are an error, and nothing is written then; an empty table is a file of none."""
    rows.sparkSession.dataSource.register(VectorSource)
    ordered = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    ordered.select(F.col("embedding").cast("array<float>").alias("embedding")).write.format("vector_file").mode("overwrite").save(path)
