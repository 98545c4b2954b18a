"""Operator 12: a trie of shared conversation prefixes, rolled up by pointer jumping.

A turn is known by the SHA-256 of its role and text, and a prefix by a digest built of runs of 32 turns, runs of 32 runs and so
on, so that no task walks along a conversation. A prefix's digest and that of the prefix one turn shorter are the edges of the
trie. Leaf counts and savings then go up by doubling: in round j each node sends what it holds of its descendants nearer than
2^j to its ancestor 2^j above, so the rounds number the logarithm of the depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Turns a run, runs a run of runs, and so on.
RUN = 32
#: A rebuilt conversation takes at most MOST - 1 turns from the first of its GROUP.
GROUP, MOST = 5, 9
#: Bytes of decimal ids that one row carries to where they are hashed.
PIECE = 1 << 16


def _nothing() -> F.Column:
    return F.lit(b"").cast("binary")


def ranked(rows: DataFrame, keys: list[str], order: list, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 of each among those of its ``keys`` (columns that are not null), by ``order``.

    Rows are dealt into ranges of (keys, order), equal ones apart by a number of their own, so a key of any size is spread.
    Places count from the rows of the key in earlier ranges.
    """
    numbered = scratch.keep(rows, f"{name}-rows").withColumn("__own", F.monotonically_increasing_id())
    by = [*(F.col(k) for k in keys), *order, F.col("__own")]
    ranges = scratch.keep(numbered.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), name)
    counts = ranges.groupBy(*keys, "__range").agg(F.count("*").alias("__here"))
    before = F.sum("__here").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order, "__own"))
    placed = ranges.withColumn("__inside", inside).join(starts, [*keys, "__range"])
    return placed.withColumn("pos", F.col("__before") + F.col("__inside") - 1).drop("__own", "__range", "__inside", "__before")


def turn_table(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and n_bytes of each turn; null roles and texts are empty, null conv_ids name no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps the two apart.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def rebuild(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations of ``turns`` (conv_id, pos, digest, n_bytes): their turns (d from 1), and all of them with n_turns."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST)).cast("long")
    convs = convs.select("conv_id", "n", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"))
    firsts = convs.filter("conv_id = first").select("first", F.col("n").alias("n_first"))
    convs = convs.join(firsts, "first", "left")
    lent = F.when(F.col("conv_id") == F.col("first"), F.least("h", "n")).otherwise(F.least(F.col("h"), F.coalesce("n_first", F.lit(0))))
    convs = convs.withColumn("lent", lent).withColumn("n_turns", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.keep(convs.select("conv_id", "first", "h", "lent", "n_turns"), "convs")
    own = turns.join(convs.select("conv_id", "first", "h", "lent"), "conv_id").filter("conv_id = first or pos >= h")
    own = own.select("conv_id", F.when(F.col("conv_id") == F.col("first"), F.col("pos")).otherwise(F.col("lent") + F.col("pos") - F.col("h")).alias("pos"), "digest", "n_bytes")
    borrowers = convs.filter("conv_id <> first and lent > 0").select("conv_id", "first", "lent")
    starts = turns.filter(F.col("pos") < MOST - 1).withColumnRenamed("conv_id", "first")
    borrowed = starts.join(borrowers, "first").filter("pos < lent").select("conv_id", "pos", "digest", "n_bytes")
    rows = own.union(borrowed).select("conv_id", (F.col("pos") + 1).alias("d"), "digest", "n_bytes")
    return rows, convs.select("conv_id", "n_turns")


def _hashed(parts) -> F.Column:
    return F.unhex(F.sha2(parts, 256))


def prefix_digests(rows: DataFrame, most: int, scratch: Scratch, level: int = 0) -> tuple[DataFrame, F.Column]:
    """``rows`` (conv_id, d, digest, ...) with the digest of the prefix up to d (key) and up to d - 1 (parent); and that of no turn.
    ``most`` is the largest d.

    A prefix is its whole runs, digested likewise one level up, and the digests of the rest: equal prefixes have equal keys, and
    a window holds one run. Levels are as many for all conversations.
    """
    run, place = F.floor((F.col("d") - 1) / RUN), (F.col("d") - 1) % RUN + 1
    rows = rows.withColumn("run", run)
    far = Window.partitionBy("conv_id", "run").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("seen", F.collect_list("digest").over(far))
    if most < RUN:  # no whole run
        below = above = none = _nothing()
    else:
        rows = scratch.keep(rows, f"runs{level}")
        ends = rows.groupBy("conv_id", "run").agg(F.max_by("seen", "d").alias("seen"))
        upper, none = prefix_digests(ends.select("conv_id", (F.col("run") + 1).alias("d"), _hashed(_joined("seen")).alias("digest")), -(-most // RUN), scratch, level + 1)
        rows = rows.join(upper.select("conv_id", (F.col("d") - 1).alias("run"), F.col("parent").alias("below"), F.col("key").alias("above")), ["conv_id", "run"])
        below, above = F.col("below"), F.col("above")
    mine = F.when(place < RUN, _hashed(F.concat(below, _joined("seen")))).otherwise(_hashed(above))
    before = _hashed(F.concat(below, _joined(F.slice("seen", F.lit(1), F.size("seen") - 1))))
    return rows.withColumn("key", mine).withColumn("parent", before).drop("run", "seen", "below", "above"), _hashed(none)


def _joined(parts) -> F.Column:
    return F.aggregate(parts, _nothing(), lambda a, b: F.concat(a, b))


def sums_below(nodes: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """Sums of ``values`` over the subtree of each node of ``nodes`` (key, parent, depth, values; the root's parent is null).

    A node that has no ancestor 2^j above takes no part in round j, so a few deep conversations cost little more than others.
    """
    now = nodes.filter("parent is not null").select("key", F.col("parent").alias("above"), "depth", *values)
    parts = nodes.select("key", *values)
    step = 0
    now = scratch.keep(now, "jump0")
    while not now.isEmpty():
        sent = now.groupBy("above").agg(*[F.sum(v).alias(v) for v in values])
        sent = scratch.keep(sent.withColumnRenamed("above", "key"), f"sent{step}")
        parts = parts.union(sent.select("key", *values))
        far = now.filter(F.col("depth") >= 2 ** (step + 1))
        jumps = now.select(F.col("key").alias("above"), F.col("above").alias("next"))
        got = sent.select("key", *[F.col(v).alias(f"got_{v}") for v in values])
        far = far.join(jumps, "above").join(got, "key", "left")
        now = scratch.keep(far.select("key", F.col("next").alias("above"), "depth", *[(F.col(v) + F.coalesce(f"got_{v}", F.lit(0))).alias(v) for v in values]), f"jump{step + 1}")
        scratch.drop(f"jump{step}")
        step += 1
    return parts.groupBy("key").agg(*[F.sum(v).alias(v) for v in values])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in their order as (key, first, ids): runs of a key's ids as decimals, comma-joined."""
    key, first, held, length = None, None, [], 0

    def closed():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(held)], pa.string())})

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (k != key or length > PIECE):
                yield closed()
                held, length = [], 0
            if not held:
                key, first = k, c
            held.append(str(c))
            length += len(held[-1]) + 1
    if held:
        yield closed()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ids) in their order as (key, ends_sha256), fed to one hash a key as they come."""
    key, state = None, None
    for batch in batches:
        keys, out = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if state:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(out, pa.string())})
    if state:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def end_digests(ends: DataFrame) -> DataFrame:
    """Of rows (key, conv_id): per key the SHA-256 of its ids, ascending and comma-joined.

    Ids are sorted in ranges over all keys and joined to pieces there; what one task streams for a key of any size is rows of
    65 kB that are hashed and dropped, since this hash can be taken in one order only."""
    ranges = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranges.mapInArrow(_pieces, "key binary, first long, ids string")
    together = pieces.repartition("key").sortWithinPartitions("key", "first")
    return together.select("key", "ids").mapInArrow(_hash_pieces, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    Turns are ordered by turn, null first, and turns of one number by the digest of role and text, so that repeated rows are
    turns of their own. Null roles and texts are empty. Rows of a null conv_id belong to no conversation and are left out.
    A conversation left without turns is a member of the root alone. Texts of any length are hashed whole. An empty table has no
    conversations, and no rows.
    """
    spark = prepare(conversations.sparkSession)
    scratch = Scratch(spark, "trie")
    placed = ranked(turn_table(conversations), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], scratch, "turns")
    turns = scratch.keep(placed.select("conv_id", "pos", "digest", "n_bytes"), "placed")
    rows, convs = rebuild(turns, scratch)
    deepest = convs.agg(F.max("n_turns")).first()[0] or 0
    prefixes, none = prefix_digests(rows, deepest, scratch)
    prefixes = scratch.keep(prefixes, "prefixes")
    inner = prefixes.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("d").alias("depth"), F.first("n_bytes").alias("n_bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(none.alias("key"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"))
    nodes = scratch.keep(inner.union(root.select(*inner.columns)), "nodes")

    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = valued.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    valued = scratch.keep(valued.drop("n_bytes"), "valued")
    totals = sums_below(valued, ["n_leaves", "saved_tokens"], scratch)

    ends = prefixes.join(convs.withColumnRenamed("n_turns", "d"), ["conv_id", "d"], "left_semi").select("key", "conv_id")
    ends = end_digests(ends.union(convs.filter("n_turns = 0").select(none, "conv_id")))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = valued.drop("n_leaves", "saved_tokens").join(totals, "key").join(ends, "key", "left").join(parents, "parent", "left")
    empty = sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
