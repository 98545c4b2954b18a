"""Operator 10: WARC archives as a Python data source, for reading and writing.

Files hold one gzip member a record. The member's header carries its compressed length in an extra field ("sl"), so a
reader that wants only headers inflates a member up to its blank line and skips the rest; files without that field, and
plain ones, are read too. Filters on record headers are applied before a payload is decoded, and payloads that the
requested schema does not name are not decoded at all.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import Scratch, prepare

#: All columns that the source knows; any of them may be asked for with ``schema``.
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, "
    "refers_to string, payload_bytes long, headers map<string,string>, payload binary"
)
WRITE_SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload binary"
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Compressed bytes after which a writer opens another file: bounds what one reading task gets.
ROLL_BYTES = 64 << 20
#: Lengths above this are left out of a member's header, which has 32 bits for them.
MOST_STATED = 0xFFFFFFFF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: every record written here carries this date, so equal input gives equal files.
_DATE = "2000-01-01T00:00:00Z"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """One gzip member with the skip length (compressed and raw) in its header, where 32 bits can state both."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 12 + 12 + len(body) + 8
    stated = max(size, len(record)) <= MOST_STATED
    head = b"\x1f\x8b\x08" + (b"\x04" if stated else b"\0") + b"\0" * 4 + b"\x02\xff"
    if stated:
        head += struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row.get('date') or _DATE}"]
    if row.get("target_uri"):
        lines.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "").replace("\n", ""))
    if row.get("payload_digest"):
        lines.append(f"WARC-Payload-Digest: {row['payload_digest']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header names in lower case to values; folded lines are joined, the version line is left out."""
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


@dataclass
class Files(InputPartition):
    path: str = ""
    names: list[str] = field(default_factory=list)

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


class _Input:
    """A file read by pieces, with a push-back buffer."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def more(self, n: int = 1 << 16) -> bytes:
        got, self.held = self.held, b""
        return got or self.stream.read(n)

    def back(self, data: bytes) -> None:
        self.held = data + self.held

    def exactly(self, n: int) -> bytes:
        got = self.held[:n]
        self.held = self.held[len(got) :]
        return got + (self.stream.read(n - len(got)) if n > len(got) else b"")

    def skip(self, n: int) -> None:
        got = min(n, len(self.held))
        self.held = self.held[got:]
        if n > got:
            self.stream.seek(self.stream.tell() + n - got)


class _Member:
    """What a gzip member of ``source`` holds, read by pieces like a file; ``source`` stands after it once ``close`` is called.

    ``size`` and ``raw`` are the member's compressed and plain lengths, if its header states them.
    """

    def __init__(self, source: _Input):
        self.source, self.inflate, self.held = source, zlib.decompressobj(-15), b""
        self.size = self.raw = None
        start = source.exactly(10)
        if len(start) < 10 or start[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.used, flags = 10, start[3]
        if flags & 4:
            (n,) = struct.unpack("<H", source.exactly(2))
            extra = source.exactly(n)
            self.used += 2 + n
            while len(extra) >= 4:
                (m,) = struct.unpack("<H", extra[2:4])
                if extra[:2] == b"sl" and m == 8:
                    self.size, self.raw = struct.unpack("<II", extra[4:12])
                extra = extra[4 + m :]
        for bit in (8, 16):
            while flags & bit:
                self.used += 1
                if source.exactly(1) in (b"\0", b""):
                    break
        if flags & 2:
            source.exactly(2)
            self.used += 2

    def more(self, n: int = 1 << 16) -> bytes:
        got, self.held = self.held, b""
        while not got and not self.inflate.eof:
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.source.exactly(n if self.size is None else min(n, self.size - self.used))
                self.used += len(data)
                if not data:
                    raise ValueError("a gzip member ends too early")
            got = self.inflate.decompress(data, 1 << 20)
        return got

    def back(self, data: bytes) -> None:
        self.held = data + self.held

    def exactly(self, n: int) -> bytes:
        parts, left = [], n
        while left and (data := self.more(min(left, 1 << 16))):
            parts.append(data[:left])
            self.back(data[left:])
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n and (data := self.more()):
            self.back(data[n:])
            n -= min(n, len(data))

    def holds_only(self, plain: int) -> bool:
        """Whether the member is known to hold one record of ``plain`` bytes and its two line ends."""
        return self.size is not None and self.raw == plain + 4

    def close(self) -> None:
        """Go to the member's end: at once where its length is stated, else through what is left of it."""
        if self.size is not None and not self.inflate.eof:
            return self.source.skip(self.size - self.used)
        self.held = b""
        while self.more():
            pass
        self.source.back(self.inflate.unused_data)
        self.source.exactly(8)


def _plain_records(f, wants) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and blocks of the records of a file or member; blocks only where ``wants(headers)``."""
    while True:
        text = b""
        while b"\r\n\r\n" not in text:
            if not (data := f.more(2048)):
                if text.strip():
                    raise ValueError("a WARC record ends within its header")
                return
            text = (text + data).lstrip(b"\r\n")
        head, _, rest = text.partition(b"\r\n\r\n")
        f.back(rest)
        headers = parse_headers(head)
        n = int(headers.get("content-length", 0))
        if wants(headers):
            block = f.exactly(n)
            if len(block) < n:
                raise ValueError("a WARC record ends within its block")
            yield headers, block
            continue
        yield headers, None
        if isinstance(f, _Member) and f.holds_only(len(head) + 4 + n):
            return
        f.skip(n)


def _gzip_records(f: _Input, wants) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The records of all members, however many a member holds."""
    while start := f.exactly(1):
        f.back(start)
        member = _Member(f)
        yield from _plain_records(member, wants)
        member.close()


def read_records(stream, wants=lambda headers: True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an open archive, gzip or plain, as (headers, block or None)."""
    f = _Input(stream)
    start = f.exactly(2)
    f.back(start)
    yield from (_gzip_records if start == b"\x1f\x8b" else _plain_records)(f, wants)


def split_http(block: bytes, content_type: str) -> tuple[dict[str, str], bytes]:
    """HTTP headers and payload of a block; blocks of other types are payload as they are."""
    if not content_type.startswith("application/http"):
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    return parse_headers(head), body


class WarcReader(DataSourceReader):
    """One partition a file (small files share one), header filters before payloads."""

    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"]
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADER_OF:
                allowed = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.equal[name] = self.equal[name] & allowed if name in self.equal else allowed
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [Files(self.path, [""])]
        infos = store.get_file_info(fs.FileSelector(root))
        sizes = {i.base_name: i.size or 0 for i in infos if i.type == fs.FileType.File}
        # What writers committed, each in a listing of its own, and nothing else; all archives where there is no listing.
        if listings := [n for n in sizes if n.startswith("_files") and n.endswith(".json")]:
            listed = []
            for name in listings:
                with store.open_input_stream(f"{root}/{name}") as f:
                    listed += json.loads(f.read())
        else:
            listed = [n for n in sizes if n.endswith((".warc", ".warc.gz"))]
        out: list[list[str]] = []
        room = 0
        for name in sorted(listed):
            if sizes[name] > room or not out:
                out.append([])
                room = ROLL_BYTES // 4
            out[-1].append(name)
            room -= sizes[name]
        return [Files(self.path, names) for names in out] or [Files(self.path, [])]

    def _passes(self, headers: dict[str, str]) -> bool:
        return all(headers.get(_HEADER_OF[c]) in allowed for c, allowed in self.equal.items())

    def read(self, partition: Files):
        store, root = _store(partition.path)
        deep = bool({"payload", "payload_bytes"} & set(self.names))
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}" if name else root) as stream:
                for headers, block in read_records(stream, lambda h: deep and self._passes(h)):
                    if self._passes(headers):
                        yield self._row(headers, block)

    def _row(self, headers: dict[str, str], block: bytes | None) -> tuple:
        http, payload = split_http(block, headers.get("content-type", "")) if block is not None else ({}, None)
        revisit = headers.get("warc-type") == "revisit"
        size = None if payload is None else int(http.get("content-length", len(payload))) if revisit else len(payload)
        row = {c: headers.get(h) for c, h in _HEADER_OF.items()} | {"headers": headers, "payload": None if revisit else payload, "payload_bytes": size}
        return tuple(row[n] for n in self.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; a commit lists those that count, so retries leave no doubles. Listings add
    up: a folder holds what all its commits list, or after an overwrite what that one does."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        attempt, names, out, size = uuid.uuid4().hex[:16], [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{attempt}-{len(names):05d}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = member(record_bytes(row))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:  # what was there before counts no more
            for i in store.get_file_info(fs.FileSelector(root)):
                if i.base_name.startswith("_files") and i.base_name.endswith(".json"):
                    store.delete_file(i.path)
        with store.open_output_stream(f"{root}/_files-{uuid.uuid4().hex[:16]}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; the path may be a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Payloads of fewer bytes are always stored in full.
LEAST_SHARED = 100


def archive_rows(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): of equal payloads of at least LEAST_SHARED bytes the one with the least
    page_id is a response and the others revisit it. Null html is an empty payload, null page_ids never revisit. A hot payload
    reaches the join as one row of its digest, against which adaptive execution splits its pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.octet_length("payload") >= LEAST_SHARED)
    shared = rows.filter("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(shared, "digest", "left")
    revisit = F.coalesce(F.col("large") & (F.col("page_id") != F.col("first")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri", F.lit(_DATE).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(revisit, urn("first")).alias("refers_to"), "payload",
    )


def write_warc(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    archive_rows(pages).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, size and digest of its full payload, type and the page it refers to.

    A response's size and digest are taken from the payload read, and an archive whose stated digest differs is an error.
    A revisit states those of the payload it stands for.
    """
    register(spark)
    got = spark.read.format("warc").schema("record_type string, record_id string, payload_digest string, refers_to string, payload_bytes long, payload binary").load(path)
    got = got.withColumn("computed", F.when(F.col("payload").isNotNull(), F.concat(F.lit("sha256:"), F.sha2("payload", 256))))
    sure = F.when(F.coalesce("computed", "payload_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("string"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) as long)")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", F.substring_index(sure, ":", -1).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back. An empty table gives no rows; columns other
    than page_id, url and html are not read; rows that repeat a page_id are records of their own. Pages of any length are one record."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_warc(pages, scratch.path("archive"))
    return read_pages(pages.sparkSession, scratch.path("archive"))
