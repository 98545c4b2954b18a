"""Pairs of sets that share an inverted list, found by bottom-k sketches without meeting all pairs of a list.

A row is a member of a list: (key, rep, comp, n, sketch), ``sketch`` being the least hashes of a set of ``n`` as bytes. Only
members of different components are compared, block by block, and only pairs whose estimate may pass come out; of pairs known to
be linked only those that connect components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The standard errors by which an estimate may fall short: at the threshold itself a pair is passed over with a chance of 3e-5.
ERRORS = 4.0
#: Members of one list that a task compares with another such block.
BLOCK = 512
#: Values that a membership matrix has as columns at once.
COLUMNS = 4096

_TOP = np.iinfo(np.uint64).max


def least_estimate(percent: int, seen, union):
    """The least share of ``seen`` values of a union of ``union`` that a linked pair may show: all of it is seen without
    error, a part of it with that of drawing without replacement."""
    p = percent / 100
    return p - ERRORS * np.sqrt(p * (1 - p) / np.maximum(seen, 1) * np.clip(1 - seen / np.maximum(union, 1), 0, 1)) - 1e-9


def promising(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int, k: int) -> bool:
    """Whether two sets of ``na`` and ``nb`` hashes may be linked, by the sketch of their union: of its least values the share
    that both hold. ``a`` and ``b`` are their sketches of at most ``k`` values; a set of no more is known whole."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    reach = min(a[-1] if na > len(a) else _TOP, b[-1] if nb > len(b) else _TOP)
    union = np.union1d(a, b)
    union = union[union <= reach][:k] if reach != _TOP else union
    both = np.intersect1d(a, b, assume_unique=True)
    both = int(np.searchsorted(both, union[-1], side="right")) if len(union) else 0
    whole = len(union) if reach == _TOP else (na + nb) / (1 + percent / 100)
    return both >= len(union) * least_estimate(percent, len(union), whole)


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many values each set on the left has in common with each on the right (on the left, if there is no other side):
    products of their membership matrices, some columns at a time."""
    names, times = np.unique(np.concatenate(left if right is None else [np.unique(np.concatenate(x)) for x in (left, right)]), return_counts=True)
    names = names[times > 1]
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    for at in range(0, len(names), COLUMNS):
        mine = _membership(left, names[at : at + COLUMNS])
        out += mine @ (mine if right is None else _membership(right, names[at : at + COLUMNS])).T
    return out.astype(np.int64)


def _membership(sets: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.minimum(np.searchsorted(names, values), len(names) - 1)
    held = names[column] == values
    out = np.zeros((len(sets), len(names)), np.float32)
    out[row[held], column[held]] = 1
    return out


def list_pairs(reps, comps, side, sizes, sketches: list[bytes], apart: bool, percent: int, k: int) -> list[tuple[int, int]]:
    """Of one list (or two blocks of one, on either ``side``): pairs of different components whose estimate may pass. Sets of at
    most ``k`` hashes are known whole, so of these only linked pairs come out, and no more than connect their components;
    pairs of other sets come out where those do not connect their components already."""
    values = [np.frombuffer(raw, np.uint64)[:k] for raw in sketches]
    # A sketch tells of all values up to its last one, or of all there are if it holds the whole set.
    reach = np.array([x[-1] if n > k else _TOP for x, n in zip(values, sizes)], np.uint64)
    every = np.arange(len(reps))
    left, right = (np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())) if apart else (every, every)
    if not len(left) or not len(right):
        return []
    n, m = sizes[left][:, None], sizes[right][None, :]
    good = (comps[left][:, None] != comps[right]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    good &= apart | (left[:, None] < right)
    if not good.any():
        return []
    both = _shared([values[i] for i in left], [values[j] for j in right] if apart else None)
    mine = np.stack([np.searchsorted(values[i], reach[right], side="right") for i in left])
    theirs = np.stack([np.searchsorted(values[j], reach[left], side="right") for j in right]).T
    either = mine + theirs - both
    known = np.minimum(reach[left][:, None], reach[right]) == _TOP
    whole = np.where(known, either, (n + m) / (1 + percent / 100))
    good &= both >= either * least_estimate(percent, either, whole)
    names, number = np.unique(comps, return_inverse=True)
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for some, linked in ((good & known, True), (good & ~known, False)):
        for i, j in zip(*(x.tolist() for x in np.nonzero(some))):
            i, j = left[i], right[j]
            if (x := top(number[i])) != (y := top(number[j])):
                found.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
                if linked:
                    root[x] = y
    return found


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _comparer(percent: int, k: int):
    """Lists come sorted by their key, so each is whole when the next begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            rows = held if batch is None else batch.to_pandas() if held is None else pd.concat([held, batch.to_pandas()], ignore_index=True)
            if rows is None or not len(rows):
                continue
            name = rows[["key", "low", "high"]].to_numpy()
            cuts = np.concatenate([[0], 1 + np.flatnonzero((name[1:] != name[:-1]).any(1)), [len(rows)]])
            last = len(cuts) - 1 if batch is None else len(cuts) - 2
            held = None if batch is None else rows.iloc[cuts[last] :]
            reps, comps, side, sizes, sketches = (rows[c].to_numpy() for c in ("rep", "comp", "side", "n", "sketch"))
            apart, found = rows["low"].to_numpy() != rows["high"].to_numpy(), set()
            for a, b in zip(cuts[:last].tolist(), cuts[1 : last + 1].tolist()):
                found.update(list_pairs(reps[a:b], comps[a:b], side[a:b], sizes[a:b], sketches[a:b], apart[a], percent, k))
            pairs = sorted(found)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def mixed_lists(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (key, rep, comp) in lists of more than one component, with the size of their list (m), its
    component of most members (major) and how many those are."""
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    mixed = counts.agg(F.sum("c").alias("m"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("most")).filter("comps > 1")
    return members.join(mixed.select("key", "m", F.col("most.comp").alias("major"), F.col("most.c").alias("m_major")), "key")


def small_pairs(mixed: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) of different components in lists of at most ``most`` members, and how many such lists they share;
    ``mixed`` is as of ``mixed_lists``."""
    rows = mixed.filter(F.col("m") <= most)
    left, right = rows.select("key", F.col("rep").alias("a"), F.col("comp").alias("ca")), rows.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    return left.join(right, "key").filter("a < b and ca <> cb").groupBy("a", "b").agg(F.count("*").alias("shared"))


def list_blocks(members: DataFrame, *columns: str, times: int = 1) -> DataFrame:
    """The rows of ``mixed_lists`` (with ``columns``) dealt into groups (key, low, high), rows of two sides in a group being
    apart where low <> high. Rows (key, low, high, side, rep, comp, ``columns``).

    A list is dealt into blocks, those of its largest component apart from the rest, and each pair of blocks is one group but
    for pairs of blocks of the largest component. So a huge group with a fringe is copied as often as the fringe has blocks.
    """
    blocks = lambda n: F.ceil(n / (BLOCK * times)).cast("int")
    rows = members.withColumn("fringe", blocks(F.col("m") - F.col("m_major"))).withColumn("core", blocks(F.col("m_major")))
    inside = F.col("comp") == F.col("major")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    rows = rows.withColumn("mine", F.when(inside, F.col("fringe") + place("core")).otherwise(place("fringe")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("fringe") - 1 + F.when(inside, 0).otherwise(F.col("core")))))
    return rows.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep", "comp", *columns)


def compared_lists(members: DataFrame, percent: int, k: int, times: int = 1) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different components in the lists of ``members`` whose estimate may pass, as of
    ``list_pairs``: all links between them connect what all links in the lists connect. Rows are those of ``mixed_lists`` with n
    and sketch; a block has BLOCK members ``times`` over, and the links passed on are as many as its members for each other block."""
    rows = list_blocks(members, "sketch", "n", times=times).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    return rows.mapInArrow(_comparer(percent, k), "a long, b long").distinct()
