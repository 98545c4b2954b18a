"""Operator 1: token ids in a word-aligned binary format (Simple-8b with escapes and per-block offsets).

A 64-bit word holds a 4-bit selector in its top bits and, below it, as many ids as the selector says, each in the same
number of bits. Selector 0 is an escape: the following word is one raw 64-bit value. Ids are dealt into blocks of 128;
every block starts on a word of its own whose number is in the block table, so a decoder visits all blocks in step.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .tokens import encoder, vocabulary

BLOCK = 128
#: Selector: (ids in a word, bits of each). Fixed values of the format; selector 0 is the escape.
LAYOUT = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC = b"PXS8B001"
#: Ids gathered before a shard is closed; bounds a worker's memory.
SHARD_IDS = 1 << 20


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for 0."""
    high, low = (values >> np.uint64(32)).astype(np.float64), (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned values to (words, block offsets): greedy choice of the selector with most ids, all blocks in step."""
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    padded = np.zeros((blocks, BLOCK + 120), np.uint64)
    padded[:, :BLOCK].flat[:n] = values
    width = np.zeros((blocks, BLOCK + 120), np.uint8)
    width[:, :BLOCK].flat[:n] = _widths(values.astype(np.uint64))
    best = np.zeros((blocks, BLOCK), np.uint8)  # selector to use when a word starts at this id
    top = width[:, :BLOCK].copy()
    by_count = sorted(((c, b, s) for s, (c, b) in enumerate(LAYOUT) if s), reverse=False)
    upto = 1
    for count, bits, selector in by_count:
        while upto < count:
            np.maximum(top, width[:, upto : upto + BLOCK], out=top)
            upto += 1
        best[top <= bits] = selector
    counts = np.array([c for c, _ in LAYOUT])
    at, ends = np.zeros(blocks, np.int64), np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    alive = np.arange(blocks)
    starts, chosen, owner, order = [], [], [], []
    step = 0
    while len(alive):
        sel = best[alive, at[alive]]
        starts.append(at[alive].copy()), chosen.append(sel), owner.append(alive), order.append(np.full(len(alive), step))
        at[alive] += counts[sel]
        alive, step = alive[at[alive] < ends[alive]], step + 1
    start, sel, own, order = (np.concatenate(x) for x in (starts, chosen, owner, order))
    by = np.lexsort((order, own))
    start, sel, own = start[by], sel[by], own[by]
    sizes = np.where(sel == 0, 2, 1)
    place = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    for s, (count, bits) in enumerate(LAYOUT):
        rows = np.flatnonzero(sel == s)
        if not len(rows):
            continue
        if s == 0:
            words[place[rows] + 1] = padded[own[rows], start[rows]]
            continue
        word = np.full(len(rows), np.uint64(s) << np.uint64(60))
        for j in range(count if bits else 0):
            word |= padded[own[rows], start[rows] + j] << np.uint64(bits * j)
        words[place[rows]] = word
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, weights=sizes, minlength=blocks))]).astype(np.uint32)
    return words, offsets


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The inverse of ``encode_blocks``: blocks advance in step, a word each, through their own offsets."""
    blocks = len(offsets) - 1
    out = np.zeros((blocks, BLOCK + 120), np.uint64)
    word_at, stop, fill = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64), np.zeros(blocks, np.int64)
    counts = np.array([c for c, _ in LAYOUT])
    alive = np.flatnonzero(word_at < stop)
    while len(alive):
        word = words[word_at[alive]]
        sel = (word >> np.uint64(60)).astype(np.int64)
        for s in np.unique(sel):
            here = alive[sel == s]
            count, bits = LAYOUT[s]
            if s == 0:
                out[here, fill[here]] = words[word_at[here] + 1]
                word_at[here] += 1
            elif bits:
                mask, w = np.uint64((1 << bits) - 1), word[sel == s]
                for j in range(count):
                    out[here, fill[here] + j] = (w >> np.uint64(bits * j)) & mask
        fill[alive] += counts[sel]
        word_at[alive] += 1
        alive = alive[word_at[alive] < stop[alive]]
    return out[:, :BLOCK].reshape(-1)[:n]


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One shard: header, doc table (id, null flag, length), block table, words."""
    lengths = np.array([len(x) for x in ids], "<u4")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    words, offsets = encode_blocks(flat.astype(np.uint64))
    head = MAGIC + struct.pack("<IQII", len(doc_ids), len(flat), len(offsets) - 1, len(words))
    known = np.array([d is not None for d in doc_ids], "u1")
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, keys.tobytes(), known.tobytes(), lengths.tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """A shard's doc ids, lengths, and the ids of all its documents in one array."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, total, blocks, count = struct.unpack_from("<IQII", blob, 8)
    at = 8 + struct.calcsize("<IQII")
    keys = np.frombuffer(blob, "<i8", docs, at)
    known = np.frombuffer(blob, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(blob, "<u4", docs, at + 9 * docs)
    offsets = np.frombuffer(blob, "<u4", blocks + 1, at + 13 * docs)
    words = np.frombuffer(blob, "<u8", count, at + 13 * docs + 4 * (blocks + 1))
    if at + 13 * docs + 4 * (blocks + 1) + 8 * count != len(blob):
        raise ValueError("a token shard of the wrong length")
    ids = decode_blocks(words, offsets, total)
    return [int(k) if y else None for k, y in zip(keys, known)], lengths, ids


SHARDS = "part int, shard int, before long, n_docs long, n_tokens long, payload binary"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, docs, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        end = np.array([end_id], "<u4")

        def closed():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "before": pa.array([before], pa.int64()), "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([pack_shard(docs, ids)], pa.binary())})

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, raw in zip(keys, encoder(path).encode(texts)):
                docs.append(key)
                ids.append(np.concatenate([raw, end]))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield closed()
                    number, before, docs, ids, held = number + 1, before + held, [], [], 0
        if docs:
            yield closed()

    return run


def write_shards(docs: DataFrame, to: str, vocab: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text; further columns are ignored) and write shards below ``to`` in ascending doc_id order.

    Null texts count as empty, null doc_ids come first, equal doc_ids are ordered by text. The table's rows are shards
    in the binary format above, written through Spark's committer, so a retried task leaves no half-written file and any
    store that Spark reaches will do. The column is stored as it is, for compression over it would hide the blocks' offsets. (part, shard) is the order of shards: parts are ascending ranges of doc_id.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = ordered.mapInArrow(_writer(vocab or vocabulary("byte_bpe_50k.json"), end_id, shard_ids), SHARDS)
    shards.write.mode("overwrite").option("compression", "uncompressed").parquet(to)


def _reader(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, lengths, ids = unpack_shard(blob)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": pa.array(bases[part] + before + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64())})

    return run


def part_bases(shards: DataFrame) -> dict[int, int]:
    """Ids before each part: the totals of parts, one row for each writing task, are summed on the driver."""
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, run = {}, 0
    for part in sorted(totals):
        bases[part] = run
        run += totals[part]
    return bases


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the written shards: doc_id, start, n_tokens (end id included) and the CRC-32 of its ids."""
    prepare(spark)
    shards = spark.read.parquet(path)
    return shards.select("part", "before", "payload").mapInArrow(_reader(part_bases(shards)), DOCS)


def encode_documents(docs: DataFrame, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back.

    Null texts hold the end id alone, repeated rows and null ids are written like others, and texts of any length are encoded
    whole (a shard is closed after the document that fills it). An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simple8b")
    write_shards(docs, scratch.path("shards"), vocab, end_id)
    return read_shards(spark, scratch.path("shards"))
