"""Operator 7: best-fit packing of documents into sequences by bin completion.

Only the number of pieces of each length matters for packing, and there are at most ``capacity`` lengths. So the corpus is
reduced to a histogram, and the branch-and-bound search over sequences runs on the histogram on the driver at a cost that does
not grow with the corpus. Its patterns (what a sequence holds, how many such sequences) are dealt out to the pieces by
their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 2
#: Nodes of the search for one sequence's fillings and fillings that it hands on, and nodes of the search over sequences beyond
#: its first descent. Beyond them incumbents stand.
FILL_NODES, FILLINGS, NODES = 4000, 6, 400
#: Pieces of one length and salt that are ranked together.
RANK_ROWS = 50_000


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each with ``items`` = ((length, copies), ...)."""

    items: tuple[tuple[int, int], ...]
    times: int


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: by volume, and by pieces of which no two fit together, refined by thresholds."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    number, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    best = -(-int(volume[-1]) // capacity)
    least = np.concatenate([[1], sizes[sizes <= capacity // 2]])
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    high, low = np.maximum(np.searchsorted(sizes, capacity - least, side="right"), half), np.searchsorted(sizes, least)
    big, mid = number[-1] - number[high], number[high] - number[half]
    room = mid * capacity - (volume[high] - volume[half])
    more = np.maximum(0, -(-(volume[half] - volume[low] - room) // capacity))
    return max(best, int((big + mid + more).max()))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """The incumbent: around each largest piece, always the largest that still fits."""
    left, out = dict(counts), []
    while any(left.values()):
        left = {s: n for s, n in left.items() if n}
        out.append(_settle(left, _greedy(left, capacity)))
    return out


def _greedy(left: dict[int, int], capacity: int, skip: int = 0) -> list[tuple[int, int]]:
    room, items = capacity, []
    for s in sorted(left, reverse=True):
        if (c := min(left[s], room // s)) and s <= room:
            c = 1 if not items else c
            items.append((s, c))
            room -= s * c
            if len(items) == 1 and left[s] > 1 and s <= room and (more := min(left[s] - 1, room // s)):
                items[0] = (s, 1 + more)
                room -= s * more
    return items


def _settle(left: dict[int, int], items: list[tuple[int, int]]) -> Pattern:
    """Use a filling as often as its pieces last."""
    times = min(left[s] // c for s, c in items)
    for s, c in items:
        left[s] -= times * c
    return Pattern(tuple(items), times)


def dominated(items: list[tuple[int, int]], rest: dict[int, int], waste: int) -> bool:
    """Whether a filling is dominated: one piece of ``rest`` could take the place of some of its pieces beside the largest, being
    as long as them together or longer by no more than the filling wastes. A piece for an equal one changes nothing."""
    most = max(s for s, _ in items)
    used = {s: c - (s == most) for s, c in items}
    sums = several = 1  # bit t: pieces of total t, and the same by two pieces or more
    several = 0
    for s, c in used.items():
        for _ in range(c):
            several |= (several << s) | ((sums & ~1) << s)
            sums |= sums << s
    left = 0
    for s, n in rest.items():
        if n - used.get(s, 0) > 0:
            left |= 1 << s
    return bool(several & left) or any((sums & ~1) << w & left for w in range(1, waste + 1))


def fillings(left: dict[int, int], capacity: int = CAPACITY, nodes: int = FILL_NODES, keep: int = FILLINGS, allowed: int | None = None) -> list[list[tuple[int, int]]]:
    """Undominated fillings around the largest piece that waste at most ``allowed``, least waste first, the fewest pieces first.

    Depth first, from large to small pieces and from many copies to few, with the best-fit filling to start with. A branch goes
    when all pieces below cannot bring its waste under that of the worst filling kept, or under what is allowed.
    """
    largest = max(s for s, n in left.items() if n)
    rest = dict(left)
    rest[largest] -= 1
    allowed = capacity if allowed is None else allowed
    sizes = sorted((s for s, n in rest.items() if n and s <= capacity - largest), reverse=True)
    below = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        below[i] = below[i + 1] + sizes[i] * rest[sizes[i]]
    found: list[tuple[int, int, list[tuple[int, int]]]] = []

    def take(items: list[tuple[int, int]], waste: int) -> None:
        if waste <= allowed and all(items != f for *_, f in found) and not dominated(items, rest, waste):
            found.append((waste, sum(c for _, c in items), items))
            found.sort(key=lambda f: f[:2])
            del found[keep:]

    start = _greedy(left, capacity)
    take(sorted(start, reverse=True), capacity - sum(s * c for s, c in start))
    # A state is the next size, the room left and what was chosen; the stack keeps the deepest branch on top.
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(0, capacity - largest, ())]
    while stack and nodes > 0 and not (len(found) >= keep and found[-1][0] == 0):
        i, room, chosen = stack.pop()
        nodes -= 1
        while i < len(sizes) and sizes[i] > room:
            i += 1
        worst = min(allowed, found[-1][0] if len(found) >= keep else capacity)
        if room - below[i] > worst:
            continue
        if i >= len(sizes):
            merged = {largest: 1}
            for s, c in chosen:
                merged[s] = merged.get(s, 0) + c
            take(sorted(merged.items(), reverse=True), room)
            continue
        s = sizes[i]
        for c in range(0, min(rest[s], room // s) + 1):  # most copies are pushed last and so tried first
            stack.append((i + 1, room - c * s, (*chosen, (s, c)) if c else chosen))
    return [items for *_, items in found] or [sorted(start, reverse=True)]


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, fill_nodes: int = FILL_NODES, keep: int = FILLINGS) -> list[Pattern]:
    """Patterns that hold all pieces: bin completion by branch and bound over sequences, with best fit as the incumbent.

    A node is what is left to pack. It goes if the sequences used and the lower bound of the rest are no fewer than the best
    solution's. Its branches are the undominated fillings around its largest piece, least waste first, that leave the total
    waste below the best solution's; each is used as often as its pieces last, or once. The search ends when the lower bound is
    met, when no branch is left (the solution is then the best there is, if ``fill_nodes`` and ``keep`` cut nothing off), or
    after ``nodes`` nodes beyond the first descent.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    total = sum(p.times for p in best)
    volume = sum(s * n for s, n in counts.items())
    free = True  # still in the first descent

    def branches(left: dict[int, int], used: int, wasted: int):
        limit = lambda: (total - 1) * capacity - volume - wasted
        seen: list = []
        # One filling leads on; the others are looked for when the search comes back.
        for k in (1, keep):
            if limit() < 0:
                return
            for items in fillings(left, capacity, fill_nodes, k, limit()):
                if items in seen:
                    continue
                seen.append(items)
                most, waste = min(left[s] // c for s, c in items), capacity - sum(s * c for s, c in items)
                for times in (most, 1) if most > 1 else (1,):
                    if waste * times <= limit():
                        rest = dict(left)
                        for s, c in items:
                            rest[s] -= times * c
                            if not rest[s]:
                                del rest[s]
                        yield Pattern(tuple(items), times), rest, used + times, wasted + waste * times

    path: list[Pattern] = []
    stack = [branches(counts, 0, 0)] if counts else []
    while stack and total > bound and (free or nodes > 0):
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            path = path[: max(len(stack) - 1, 0)]
            free = False
            continue
        pattern, left, used, wasted = step
        nodes -= not free
        path = [*path[: len(stack) - 1], pattern] if not free else [*path, pattern]
        if not left:
            if used < total:
                best, total = list(path), used
            path, free = path[: len(stack) - 1], False
        elif used + lower_bound(left, capacity) < total:
            stack.append(branches(left, used, wasted))
        else:
            path = path[: len(stack) - 1]
    return best


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity when there are more."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def _piecer(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), encoder(path).encode([t or "" for t in batch.column(1).to_pylist()])):
                view = memoryview(np.concatenate([raw, end]).tobytes())
                rows += [(key, i, s, n, zlib.crc32(view[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut_pieces(len(view) // 4, capacity))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32())} | {n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "ids_crc32"), cols[2:])})

    return run


def tokenised_pieces(docs: DataFrame, vocab: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_piecer(vocab or vocabulary("byte_bpe_50k.json"), end_id, capacity), PIECES)


def _placer(starts: np.ndarray, table: np.ndarray):
    """``starts``: first key (length, rank) of each interval; ``table``: its rank, sequence, copies and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1]
            done = rank - row[:, 0]
            sequence, slot = row[:, 1] + done // row[:, 2], row[:, 3] + done % row[:, 2] * length
            keep = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(keep | {"sequence_id": pa.array(sequence), "offset": pa.array(slot)})

    return run


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table as of ``tokenised_pieces``) with sequence_id and offset."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    starts, table, sequence, used = [], [], 0, dict.fromkeys(counts, 0)
    for p in solve(counts, capacity):
        at = 0
        for s, c in p.items:
            starts.append(s * (1 << 44) + used[s])
            table.append((used[s], sequence, c, at))
            used[s] += p.times * c
            at += s * c
        sequence += p.times
    order = np.argsort(np.array(starts, np.int64))
    starts, table = np.array(starts, np.int64)[order], np.array(table, np.int64).reshape(-1, 4)[order]
    # Ranks within a length: within salts that hold a bounded number of pieces, then by the salts' counts.
    many = [(s, n // RANK_ROWS) for s, n in counts.items() if n > RANK_ROWS]  # at most ``capacity`` lengths
    salts = F.coalesce(F.create_map(*[F.lit(x) for pair in many for x in pair])[F.col("length").cast("int")], F.lit(1)) if many else F.lit(1)
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts.cast("long")))
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("within", within).join(sizes, ["length", "salt"]).withColumn("rank", (F.col("within") + F.col("before")).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placer(starts, table), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text; other columns are not read) into sequences of at most ``capacity`` tokens.

    Null texts are empty and hold the end id alone. Documents longer than a sequence are cut into full pieces, after a
    first that may be shorter; texts of any length are packed whole. Repeated rows and null ids are packed like others, and rows
    alike in all columns are interchangeable. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    return place_pieces(scratch.keep(tokenised_pieces(docs, vocab, end_id, capacity), "pieces"), capacity)
