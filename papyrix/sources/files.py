"""The files of an export: a data source that lists folders on the executors, and contents read there with an error a file."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .matcher import Matcher

#: Folders that the driver lists to plan; each folder below those is one task with all that is under it.
PLANNED = 256
#: Bytes of contents that one task reads, about, and files.
TASK_BYTES, TASK_FILES = 128 << 20, 2000
#: Bytes of contents that one Arrow batch holds, about.
BATCH_BYTES = 8 << 20
#: Fixed value: the settings of a source, in its top folder.
SETTINGS = "corpus.yaml"

CONTENTS = "file string, length long, content binary, error string"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or URI, and the folder's path in it."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder.rstrip("/"))
    return pafs.LocalFileSystem(), os.path.abspath(folder)


def reachable(folder: str) -> bool:
    """Whether Python can open the folder's file system; others are left to Spark's own readers."""
    try:
        fs, path = opened(folder)
        return fs.get_file_info(path).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException, ValueError):
        return False


def _length(entry: os.DirEntry) -> int:
    """Of a file or of what a link leads to; 0 of what is no file."""
    try:
        found = entry.stat()
        return found.st_size if stat.S_ISREG(found.st_mode) else 0
    except OSError:
        return 0


@dataclass
class Folder(InputPartition):
    """A folder to list, with all that is below it if ``deep``."""

    rel: str
    deep: bool


class FolderReader(DataSourceReader):
    """Files by the rules of a source: folders that are excluded are never listed, and links to folders are not followed."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.exclude, self.include = Matcher(json.loads(options.get("exclude", "[]"))), Matcher(json.loads(options.get("include", "[]")))
        self.any_file = not json.loads(options.get("include", "[]"))

    def _list(self, fs: pafs.FileSystem, base: str, rel: str) -> Iterator[tuple[str, bool, int]]:
        """(path below the root, whether it is a folder, length) of what a folder holds; a folder that cannot be listed is passed over."""
        path = f"{base}/{rel}".rstrip("/")
        try:
            if isinstance(fs, pafs.LocalFileSystem):  # which alone has links; those that lead nowhere are files that cannot be read
                with os.scandir(path) as entries:
                    infos = [(e.name, e.is_dir(follow_symlinks=False), _length(e)) for e in entries]
            else:
                infos = [(i.base_name, i.type == pafs.FileType.Directory, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(path))]
        except OSError:
            return
        for name, folder, length in infos:
            yield f"{rel}/{name}".lstrip("/"), folder, length

    def partitions(self) -> list[InputPartition]:
        fs, base = opened(self.root)
        todo, parts = [""], []
        while todo and len(parts) < PLANNED:
            rel = todo.pop(0)
            parts.append(Folder(rel, False))
            todo += [name for name, folder, _ in self._list(fs, base, rel) if folder and not self.exclude.match_dir(name)]
        return parts + [Folder(rel, True) for rel in todo]

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, base = opened(self.root)
        todo = [partition.rel]
        while todo:
            for name, folder, length in self._list(fs, base, todo.pop()):
                if folder:
                    todo += [name] if partition.deep and not self.exclude.match_dir(name) else []
                elif name != SETTINGS and not self.exclude.match_file(name) and (self.any_file or self.include.match_file(name)):
                    yield name, length


class FolderSource(DataSource):
    """``spark.read.format("export_folder")``: rows (file, length) below ``path``, by JSON lists of ``include`` and ``exclude`` patterns."""

    @classmethod
    def name(cls) -> str:
        return "export_folder"

    def schema(self) -> str:
        return "file string, length long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def listing(spark: SparkSession, folder: str, exclude: list[str], include: list[str]) -> DataFrame:
    """Rows (file, length) of a source's files, as paths below ``folder``; none is opened and none passes through the driver."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("export_folder").option("exclude", json.dumps(exclude)).option("include", json.dumps(include)).load(folder)


def _reader(folder: str, largest: int):
    schema = pa.schema([("file", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        rows, held = [], 0
        for batch in batches:
            for file, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content, error = None, None
                if length > largest:
                    error = f"{file} is too large"
                else:
                    try:
                        with fs.open_input_stream(f"{base}/{file}") as stream:
                            content = stream.read()
                    except OSError as e:
                        error = f"{file} cannot be read: {os.strerror(e.errno) if e.errno else type(e).__name__}"
                rows.append({"file": file, "length": length, "content": content, "error": error})
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def contents(listed: DataFrame, folder: str, largest: int, workers: int = 1) -> DataFrame:
    """Rows (file, length, content, error) of a stored listing. A file above ``largest`` bytes is not read, and one that cannot be
    read costs no other: either has an error instead of a content. Files are dealt out by their number and bytes, to ``workers`` tasks at least."""
    total = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("length") <= largest, F.col("length"))), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(total.n, max(workers, -(-total.bytes // TASK_BYTES), -(-total.n // TASK_FILES))))
    return listed.select("file", "length").repartition(tasks, "file").mapInArrow(_reader(folder, largest), CONTENTS)
