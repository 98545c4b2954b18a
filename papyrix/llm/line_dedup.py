"""Operator 8: fuzzy line deduplication by MinHash.

Equal lines are one class. A class is signed by the minima of its character shingles' hashes under permutations; the minima of a
band together open a list. Each class is first compared with the hubs that it shares most lists with, a list having two; what
that links is contracted into components, and then the classes of different components that share a hub are compared: with few
hubs of a long list a round while rounds join components, and then with each other. Of all these pairs, bitmaps of the shingles
rule out most that cannot be linked, and none that can. Linked means a Jaccard similarity of all character shingles at the
threshold, which is always computed exactly.

All of it is DataFrame functions: shingles are rows of a few positions that are folded into minima where they are made, and the
sets of a pair are arrays (rows for very long lines).
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetable import mix
from .candidates import list_blocks, mixed_lists, small_pairs
from .common import Scratch
from .components import connected_components

#: Characters of a shingle, and the least Jaccard similarity in percent.
SHINGLE, PERCENT = 8, 80
#: Bands and minima of a band. Two lines share no band with a chance of (1 - 0.8 ** 3) ** 8 = 0.003 at a similarity of 0.8, and
#: of 0.00003 at 0.9.
BANDS, ROWS = 8, 3
#: Hubs that a class is compared with at first, and hubs of a long list in each round.
HUBS = 3
#: Members up to which all pairs of a hub's classes are compared without rounds.
SMALL = 4
#: Members that each member of the long lists meets on average up to which no round of hubs is made before all meet.
MET = 64
#: Longs of a bitmap of shingles.
WORDS = 16
#: Hashes of a sketch, where lists are compared by those (``candidates.list_pairs``).
SKETCH = 512
#: Classes whose ids are broadcast to fetch their lines; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Positions that a row of shingles stands for, and shingles of a part of a very long line.
AT_ONCE, CHUNK = 4, 1 << 16

_SPACES = " \t\n\x0b\x0c\r"
_NO_DOC = (1 << 63) - 1
#: Hashes of 31 bits times odd numbers of 32 bits, modulo 2 ** 32, are permutations that do not overflow.
_TIMES = [int(x) >> 32 | 1 for x in mix(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
#: The last start of a shingle in text as UTF-32 (four bytes a character), and the hash of the shingle at a start.
_LAST = f"greatest(shiftright(octet_length(wide), 2) - {SHINGLE}, 0)"
_HASH = f"xxhash64(substring(wide, 4 * {{}} + 1, {4 * SHINGLE}))"


def _sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted sets of shingle hashes of a few lines, without Spark."""
    one = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest())
    return [np.unique(np.array([one(x[i : i + SHINGLE]) for i in range(max(len(x) - SHINGLE + 1, 1))], np.uint64)) for x in lines]


def visible_lines(rows: DataFrame) -> DataFrame:
    """The lines of ``rows`` (row, doc_id, text) that hold more than white space: row, doc_id, line_no, digest, line."""
    lines = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.filter(F.ltrim("line", F.lit(_SPACES)) != "")
    return lines.select("row", "doc_id", F.col("line_no").cast("long").alias("line_no"), F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("digest"), "line")


def _wide_parts(texts: DataFrame) -> DataFrame:
    """The lines of ``texts`` (node, line) as UTF-32, very long ones as overlapping parts that have their shingles together."""
    n = F.length("line")
    parts = texts.select("node", "line", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - SHINGLE, F.lit(0)) / CHUNK).cast("int"))).alias("part"))
    part = F.when(n <= CHUNK, F.col("line")).otherwise(F.substring("line", F.col("part") * CHUNK + 1, F.lit(CHUNK + SHINGLE - 1)))
    return parts.select("node", F.encode(part, "UTF-32").alias("wide"))


def _hashes(texts: DataFrame) -> DataFrame:
    """The shingles of the lines of ``texts`` (node, line), AT_ONCE positions a row, so that few rows are grouped: node, h0, h1
    and so on (31 bits; the last one over again beyond the end). A line that is shorter than a shingle is one of its own."""
    rows = _wide_parts(texts).select("node", "wide", F.expr(_LAST).alias("last"))
    rows = rows.select("node", "wide", "last", F.explode(F.expr(f"sequence(0, last, {AT_ONCE})")).alias("i"))
    hashes = [F.expr(_HASH.format(f"least(i + {k}, last)") + f" & {(1 << 31) - 1}L").alias(f"h{k}") for k in range(AT_ONCE)]
    return rows.select("node", *hashes)


def band_keys(texts: DataFrame) -> DataFrame:
    """The keys of the bands of each line of ``texts`` (node, line): node, keys."""
    permuted = lambda k, times: (F.col(f"h{k}") * F.lit(times)).bitwiseAND(F.lit((1 << 32) - 1))
    minima = _hashes(texts).groupBy("node").agg(*[F.min(F.least(*[permuted(k, times) for k in range(AT_ONCE)])).alias(f"m{j}") for j, times in enumerate(_TIMES)])
    return minima.select("node", F.array(*[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]).alias("keys"))


def _set(line: str) -> Column:
    """The distinct shingle hashes of a line that is not very long, its wide form being made once."""
    return F.array_distinct(F.expr(f"transform(array(encode({line}, 'UTF-32')), wide -> transform(sequence(0, {_LAST}), i -> {_HASH.format('i')}))[0]"))


def _enough(na: str, nb: str, both: str, percent: int) -> Column:
    return 100 * F.col(both) >= percent * (F.col(na) + F.col(nb) - F.col(both))


def texts_of(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lines of the classes ``nodes``: node, line, and whether it is a very long one."""
    return classes.select("node", "line").join(nodes, "node").select("node", "line", (F.length("line") > CHUNK).alias("long"))


def _verified_by_rows(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """``verified`` for lines of any length: a shingle is a row, so no set is held by a task."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parts = _wide_parts(texts.join(nodes, "node").select("node", "line"))
    starts = parts.select("node", "wide", F.explode(F.expr(f"sequence(0, {_LAST})")).alias("i"))
    sets = scratch.keep(starts.select("node", F.expr(_HASH.format("i")).alias("h")).distinct(), f"{name}-sets")
    left, right = sets.select(F.col("node").alias("a"), "h"), sets.select(F.col("node").alias("b"), "h")
    both = pairs.join(left, "a").join(right, ["b", "h"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    sizes = sets.groupBy("node").agg(F.count("*").alias("n"))
    both = both.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return both.filter(_enough("na", "nb", "both", percent)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose lines in ``texts`` (node, line, long) are linked, stored as ``name``."""
    left, right = (texts.select(F.col("node").alias(x), F.col("line").alias(f"l{x}"), F.col("long").alias(f"long_{x}")) for x in "ab")
    whole = pairs.join(left.filter("not long_a"), "a").join(right.filter("not long_b"), "b").select("a", "b", _set("la").alias("sa"), _set("lb").alias("sb"))
    # The sizes are a generated row, so that the filter on them is not evaluated with the sets made anew for each.
    sizes = whole.select("a", "b", F.inline(F.array(F.struct(F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both")))))
    links = sizes.filter(_enough("na", "nb", "both", percent)).select("a", "b")
    if not texts.filter("long").isEmpty():
        some = pairs.join(left.drop("la"), "a").join(right.drop("lb"), "b").filter("long_a or long_b").select("a", "b")
        links = links.union(_verified_by_rows(scratch.keep(some, f"{name}-long"), texts, percent, scratch, name))
    return scratch.keep(links, name)


def bitmaps(texts: DataFrame) -> DataFrame:
    """Per line of ``texts`` (node, line, long): rep, n (the size of its set), and WORDS longs, in which the bit is set of each
    place that an odd number of its set falls on; zeros for very long lines."""
    rows = texts.select(F.col("node").alias("rep"), F.explode_outer(F.when(~F.col("long"), _set("line"))).alias("h"))
    rows = rows.select("rep", "h", F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"), F.expr(f"shiftrightunsigned(h, 6) % {WORDS}").alias("word"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("word") == j, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{j}") for j in range(WORDS)]
    return rows.groupBy("rep").agg(F.count("h").alias("n"), *words)


def _near(x: str, y: str, percent: int) -> Column:
    """Whether lines with ``bitmaps`` may be linked: always if one is very long. Two sets differ in no fewer shingles than their
    bitmaps differ in bits, and linked ones in at most (1 - t) / (1 + t) of the sum of their sizes."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.w{j}").bitwiseXOR(F.col(f"{y}.w{j}"))) for j in range(WORDS)])
    close = (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * apart <= (100 - percent) * (a + b))
    return (a == 0) | (b == 0) | close


def near_pairs(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that ``bitmaps`` do not rule out."""
    met = pairs.join(bits.alias("x"), F.col("a") == F.col("x.rep")).join(bits.alias("y"), F.col("b") == F.col("y.rep"))
    return met.filter(_near("x", "y", percent)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _hub_pairs(long: DataFrame, percent: int, step: int) -> DataFrame:
    """Pairs of the members of each list of ``long`` (key, rep, comp, bitmaps) with a few of them, of other components."""
    masks = [int(x) >> 2 for x in mix(np.arange(1 + step * HUBS, 1 + (step + 1) * HUBS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
    chosen = long.groupBy("key").agg(F.array_distinct(F.array(*[F.min(F.col("rep").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in masks])).alias("reps"))
    hubs = long.join(chosen.select("key", F.explode("reps").alias("rep")), ["key", "rep"])
    met = long.alias("x").join(hubs.alias("y"), F.col("x.key") == F.col("y.key"))
    return _ordered(met.filter((F.col("x.comp") != F.col("y.comp")) & _near("x", "y", percent)))


def _all_pairs(long: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components of each list of ``long`` (as of ``mixed_lists``, with bitmaps), which may be
    linked. Members are dealt into blocks, and those of a pair of blocks meet."""
    rows = list_blocks(long, "n", *[f"w{j}" for j in range(WORDS)])
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "low", "high")]
    once = F.when(F.col("x.low") == F.col("x.high"), F.col("x.rep") < F.col("y.rep")).otherwise(F.col("y.side") == 1)
    met = rows.filter("side = 0").alias("x").join(rows.alias("y"), same[0] & same[1] & same[2])
    return _ordered(met.filter((F.col("x.comp") != F.col("y.comp")) & once & _near("x", "y", percent)))


def line_links(lines: DataFrame, scratch: Scratch, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, components) of stored ``visible_lines``: classes (node, digest, first, repeated, line), ``first`` being the
    document, line, digest and row where it is met first; components (node, component) of the linked ones."""
    place = F.struct(F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc"), "line_no", "row")
    classes = lines.groupBy("digest").agg(F.min(place).alias("first"), (F.count("*") > 1).alias("repeated"), F.any_value("line").alias("line"))
    first = F.struct("first.doc", "first.line_no", "digest", "first.row").alias("first")
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("node"), "digest", first, "repeated", "line"), "classes")
    keys = scratch.keep(band_keys(classes.select("node", "line")), "keys")
    # Most lists hold one class, so their keys are counted first, by partial sums, and only members of shared ones go on.
    members = keys.select("node", F.explode("keys").alias("key"))
    lists = members.groupBy("key").agg(F.min("node").alias("n0"), F.max("node").alias("n1")).filter("n0 < n1")
    bands = scratch.keep(members.join(lists, "key"), "bands")
    scratch.drop("keys")
    met = scratch.keep(bands.select("node").distinct(), "met")
    texts = scratch.keep(texts_of(classes, F.broadcast(met) if met.count() <= BROADCAST else met), "texts")
    bits = scratch.keep(bitmaps(texts), "bits")
    # Of the hubs of its lists, those with which a class shares most of them.
    hubs = bands.select("node", F.explode(F.array("n0", "n1")).alias("hub")).filter("hub <> node").groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = hubs.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "hub"))).filter(F.col("place") <= HUBS)
    first = best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = scratch.keep(near_pairs(first, bits, percent), "first")
    links = verified(tried, texts, percent, scratch, "links0")
    # Classes that share a list share its first hub, and near copies share it in most of their lists: one list of it stands for all.
    rows = scratch.keep(bands.select("node", F.col("n0").alias("key")).distinct(), "rows")
    scratch.drop("bands")
    step, before = 0, None
    while True:
        comps = connected_components(links, scratch, f"cc{step}-").select("node", "component")
        mine = rows.join(comps, "node", "left").select("key", F.col("node").alias("rep"), F.coalesce("component", "node").alias("comp"))
        mixed = scratch.keep(mixed_lists(mine), f"mixed{step}")
        long = mixed.filter(F.col("m") > SMALL)
        members, meetings = long.agg(F.count("*"), F.coalesce(F.sum(F.col("m") - F.col("m_major")), F.lit(0))).first()
        long = long.join(bits, "rep")
        if meetings <= MET * members or before is not None and 4 * meetings > 3 * before:
            break
        # Rounds go on while each spares a quarter of the meetings.
        fresh = scratch.keep(_hub_pairs(long, percent, step).join(tried, ["a", "b"], "left_anti"), f"fresh{step}")
        links, tried = links.union(verified(fresh, texts, percent, scratch, f"links{step + 1}")), tried.union(fresh)
        step, before = step + 1, meetings
    pairs = near_pairs(small_pairs(mixed, SMALL).select("a", "b"), bits, percent).union(_all_pairs(long, percent)).distinct()
    rest = scratch.keep(pairs.join(tried, ["a", "b"], "left_anti"), "rest")
    links = links.union(verified(rest, texts, percent, scratch, "links"))
    return classes, connected_components(links, scratch, "lines")


def _decided(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Per visible line of ``docs`` (row, doc_id, text): row, doc_id, line_no, digest, kept (a struct as ``first``, null for a
    line without company) and whether it is that line."""
    lines = scratch.keep(visible_lines(docs), "visible")
    classes, found = line_links(lines, scratch, percent)
    mine = classes.select("node", "digest", "first", "repeated").join(found, "node", "left").select("digest", "first", "repeated", "component")
    together = mine.filter("component is not null")
    best = together.groupBy("component").agg(F.min("first").alias("kept"))
    company = together.join(best, "component").select("digest", "kept").unionByName(mine.filter("component is null and repeated").select("digest", F.col("first").alias("kept")))
    rows = lines.select("row", "doc_id", "line_no", "digest").join(scratch.keep(company, "company"), "digest", "left")
    here = F.col("kept").isNull() | ((F.col("kept.row") == F.col("row")) & (F.col("kept.line_no") == F.col("line_no")))
    return rows.select("row", "doc_id", "line_no", "digest", "kept", here.alias("stays"))


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per visible line of ``docs`` (doc_id, text): doc_id, line_no (from 0), keep_doc_id, keep_line_no and keep_digest of the
    line that stays for it, and whether it is that line.

    Of a component of linked lines one line stays: that of the least doc_id (null after all others), in it the first. Rows that
    repeat a doc_id are told apart, so still one line stays. Lines without visible characters are no lines here, and null
    texts have none. Lines of any length are compared whole. An empty table gives no rows; other columns are not read.
    """
    rows = _decided(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), percent, Scratch(docs.sparkSession, "line-dedup"))
    doc = F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("kept.doc"), F.lit(_NO_DOC)))
    return rows.select("doc_id", "line_no", doc.alias("keep_doc_id"), F.coalesce("kept.line_no", "line_no").alias("keep_line_no"), F.lower(F.hex(F.coalesce("kept.digest", "digest"))).alias("keep_digest"), F.col("stays").alias("kept"))


def drop_repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the lines that do not stay taken out of their texts; blank lines, null texts and other columns are as
    before. Rows are told apart by their place in the table, which is written to the shared folder first, so rows that share
    a doc_id, or repeat a text, or have no id lose their own lines alone."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    stored = scratch.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
    gone = _decided(stored.select(F.col("__row").alias("row"), "doc_id", "text"), percent, scratch).filter("not stays")
    gone = gone.groupBy(F.col("row").alias("__row")).agg(F.collect_list("line_no").alias("__gone"))  # a text's lines
    rows = stored.join(gone, "__row", "left")
    parts = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains(F.col("__gone"), i.cast("long")), F.lit(False)))
    return rows.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(parts, "\n"))).select(*docs.columns)
