"""Operator 9: near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of hashes of its 5-word shingles. Its sketch is the least k of them. Inverted lists of the least retained
values generate overlaps: how many of them two documents both hold. A value that many documents hold (a shared passage, a huge
group of copies) has too long a list for that, so it is split: its documents meet in lists of several retained values taken
together. Candidates are estimated from the sketch of their union, and those that may pass are verified on full sets.

No long list is expanded into all its pairs. Documents with equal sets are one class from the start. Every class is first
compared with the least class of the list that it shares most lists with; what that links is contracted into components, and
only classes of different components are compared further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules, tokens
from .bytetable import concat, mix, span_hashes, word_spans
from .candidates import compared_lists, mixed_lists, promising, small_pairs
from .common import Scratch, prepare
from .components import connected_components

WORDS = 5
#: Link when PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Retained values: for the sketch, and those of them that open inverted lists. Of the least LISTS values of a union at a
#: similarity of 0.85 both documents hold fewer than SHARED with a chance of 7e-8 (at 0.8: 5e-6), and such pairs are passed over.
SKETCH, LISTS, SHARED = 256, 12, 3
#: Members up to which an inverted list generates overlaps; documents with SHARED values in longer ones meet in compound lists.
LONG = 32
#: Compound lists: each takes BAND_BINS retained values together, the least ones of as many of BINS hash bins.
BINS, BANDS, BAND_BINS = 64, 32, 6
#: Ids of documents (8 bytes each) that are broadcast rather than joined by a shuffle.
BROADCAST_IDS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(max(n - 1, 0), _BASE), out=out[1:])
    return out


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """For each text (UTF-8) the sorted distinct 64-bit hashes of its word shingles.

    Words are hashed in one pass over the bytes of all texts; a shingle's hash is a mix of its words' hashes. A text with
    fewer than ``size`` words is one shingle of all its words, and one without words has none.
    """
    data, bounds = concat(texts)
    lower = _LOWER[data]
    starts, ends, per_text = word_spans(lower, bounds)
    word = span_hashes(lower, starts, ends)
    first = np.concatenate([[0], np.cumsum(per_text)])
    out = []
    powers, odd = _powers(size), np.arange(1, size + 1).astype(np.uint64) * _ODD
    n = len(word)
    m = max(n - size + 1, 0)
    grams = np.zeros(m, np.uint64)
    for j in range(size):
        grams += mix(word[j : j + m] + odd[j]) * powers[j]
    grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for j in range(a, b):
                h = mix(h * _BASE + word[j : j + 1] + _ODD)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def band_lists() -> np.ndarray:
    """For each band the bins it takes together: a fixed choice, the same everywhere."""
    return np.array([np.random.default_rng(1000 + b).permutation(BINS)[:BAND_BINS] for b in range(BANDS)])


_BANDS = band_lists()


def band_keys(sets: np.ndarray) -> np.ndarray:
    """One key a band: the least retained value of each of its bins, together."""
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    kept = sets[: BINS * 8]
    np.minimum.at(least, (kept & np.uint64(BINS - 1)).astype(np.int64), kept)
    keys = np.full(BANDS, 0, np.uint64)
    for j in range(BAND_BINS):
        keys = mix(keys * _BASE + least[_BANDS[:, j]] + _ODD)
    return mix(keys + np.arange(BANDS).astype(np.uint64) * _ODD)


SKETCHED = "doc_id long, n_shingles long, digest string, singles array<long>, bands array<long>"


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A worker that has served tokenising stages before still holds their tables, a hundred megabytes and more.
    quality_rules._pieces.cache_clear()
    tokens.encoder.cache_clear()
    for batch in batches:
        sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
            "singles": pa.array([_signed(s[:LISTS]) for s in sets], pa.list_(pa.int64())),
            "bands": pa.array([_signed(band_keys(s)) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64())),
        })


def sketch_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): set size, digest of the set, and the keys of its lists."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketcher, SKETCHED)


def _set_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_pydict({"rep": batch.column(0), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (rep, hashes): the whole sets of the documents whose ids are in ``wanted`` (rep)."""
    if wanted.count() <= BROADCAST_IDS:  # else the texts are shuffled to the ids
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")
    return rows.mapInArrow(_set_reader, "rep long, hashes binary").dropDuplicates(["rep", "hashes"])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact rule on whole sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def _estimator(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("xa", "xb", "na", "nb")))
            chosen = pa.array([promising(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m, percent, SKETCH) for x, y, n, m in rows], pa.bool_())
            yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(chosen) for n in ("a", "b")})

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())
            chosen = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(chosen) for n in ("a", "b")})

    return run


def sketches_of(sets: DataFrame) -> DataFrame:
    """Rows (rep, n, sketch) of ``full_sets``."""
    return sets.select("rep", F.expr("octet_length(hashes) div 8").alias("n"), F.expr(f"substring(hashes, 1, {8 * SKETCH})").alias("sketch")).filter("n > 0")


def verify(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are linked. Sketches meet first, and full sets only where the estimate may pass."""
    side = lambda c, s: sketches_of(sets).select(F.col("rep").alias(c), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"x{s}"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    met = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").filter(near).select("a", "b", "xa", "xb", "na", "nb")
    met = scratch.keep(met.mapInArrow(_estimator(percent), "a long, b long"), f"{name}-promising")
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    return scratch.keep(met.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(_verifier(percent), "a long, b long"), name)


def near_dup_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the least
    doc_id reachable over links and kept marks the document that bears it. Null texts and texts without words have empty
    sets and are linked with nothing. Repeated rows share their document's component; a null doc_id is a component of
    its own with a null id, and not kept. Texts of any length are shingled whole. Rows that share a doc_id are one document, linked by any of its texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    sketched = scratch.keep(sketch_documents(docs), "sketched")
    # Classes of equal sets; a class goes by its least doc_id.
    some = sketched.filter("digest is not null and doc_id is not null")
    classes = scratch.keep(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = some.join(classes, "digest").filter("doc_id = rep").dropDuplicates(["rep", "digest"]).select("rep", "singles", "bands")
    keyed = scratch.keep(keyed, "keyed")
    # Inverted lists of retained values; those of long ones are split by several values.
    # Lists are counted by partial sums first, and joins against the counts may split a hot key.
    singles = keyed.select("rep", F.explode("singles").alias("key"))
    counts = singles.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("head")).filter("m > 1")
    held = scratch.keep(singles.join(counts, "key"), "singles")
    short = held.filter(F.col("m") <= LONG).select("key", "rep", "head", F.lit(True).alias("short"))
    dense = scratch.keep(held.filter(F.col("m") > LONG).groupBy("rep").agg(F.count("*").alias("long")), "dense")
    bands = keyed.select("rep", "bands").join(dense.filter(F.col("long") >= SHARED).select("rep"), "rep").select("rep", F.explode("bands").alias("key"))
    compound = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("head")).filter("m > 1").select("key", "head")
    compound = bands.join(compound, "key").select("key", "rep", "head", F.lit(False).alias("short"))
    lists = scratch.keep(short.unionByName(compound), "lists")
    # First every class against the head that it shares most lists with, then components of what is linked.
    shared = lists.filter("head < rep").groupBy("rep", "head").agg(F.count("*").alias("n")).groupBy("rep")
    heads = scratch.keep(shared.agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("a")).select("a", F.col("rep").alias("b")), "heads")
    sets = scratch.keep(full_sets(docs, lists.select("rep").distinct()), "sets")
    first = verify(heads, sets, scratch, "links0", percent)
    comps = connected_components(first, scratch, "first").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    # Then the classes of different components that meet in a list: overlaps in short lists, estimates in long ones.
    members = lists.join(comps, "rep", "left").select("key", "short", "rep", F.coalesce("comp", "rep").alias("comp"))
    overlaps = small_pairs(mixed_lists(members.filter("short")), LONG)
    longs = lambda c: dense.select(F.col("rep").alias(c), F.col("long").alias(f"long_{c}"))
    reach = F.col("shared") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    overlaps = overlaps.join(longs("a"), "a", "left").join(longs("b"), "b", "left").filter(reach >= SHARED).select("a", "b")
    mixed = scratch.keep(mixed_lists(members.filter("not short")), "mixed")
    more = overlaps.union(compared_lists(mixed.join(sketches_of(sets), "rep"), percent, SKETCH)).distinct()
    more = scratch.keep(more.join(heads, ["a", "b"], "left_anti"), "more")
    links = first.unionByName(verify(more, sets, scratch, "links", percent))
    final = connected_components(scratch.keep(links, "links1"), scratch, "final").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    final = classes.join(final, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(final, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays: the rows of ``docs`` with its component's least doc_id, as they were.
    Rows with a null doc_id, being linked with nothing, all stay."""
    gone = near_dup_components(docs, percent).filter("doc_id is not null and not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
