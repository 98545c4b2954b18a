"""Near duplicates across sources within a window of days: pairs, transitive groups, winners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import Scratch
from ..functions import text

#: Days on either side, least similarity, words of a shingle.
WINDOW_DAYS, THRESHOLD, SHINGLE_WORDS = 2, 0.5, 5
#: Shingles of a part, about, each document counting as ROW more; shingles that are looked up at a time.
CELL, ROW, STEP = 1 << 20, 64, 1 << 20
#: Documents that may have partners up to which their ids are broadcast to fetch their sets; more are joined by a shuffle.
BROADCAST = 1_000_000


def check_options(window: int, threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    if window < 0:
        raise ValueError("the window is not negative")


def least_overlap(size, threshold: float) -> F.Column:
    """The fewest common shingles with which a set of ``size`` can reach ``threshold``: the least n with n / size >= threshold.

    The product may be off by a rounding, so the whole number below it is tried by the division that scores are compared by."""
    near = F.ceil(size * threshold)
    return F.greatest(F.lit(1), F.when((near - 1) / size >= threshold, near - 1).otherwise(near)).cast("int")


def shingle_table(documents: DataFrame) -> DataFrame:
    """Documents as (id, source, day, size, h): their shingles as sorted 64-bit hashes of runs of words, day null if undated."""
    rows = documents.select("id", "source", text.day_number(F.col("published")).alias("day"), F.sort_array(text.shingle_hashes(text.shingle_words(F.col("text")))).alias("h"))
    return rows.select("id", "source", "day", F.size("h").alias("size"), "h")


def pairs(documents: DataFrame, window: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, score) of different sources, at most ``window`` days apart, with Jaccard at least ``threshold``."""
    check_options(window, threshold)
    return set_pairs(Scratch(documents.sparkSession, "dupes").keep(shingle_table(documents), "sets"), window, threshold)


def set_pairs(stored: DataFrame, window: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """``pairs`` of a stored ``shingle_table``. Exact."""
    return _met(close_sets(stored, window, threshold), window, threshold, False)


def set_links(stored: DataFrame, window: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that connect whatever ``set_pairs`` connects: of what a task has linked already, no more pairs are tried."""
    return _met(close_sets(stored, window, threshold), window, threshold, True).select("a", "b")


def _slabbed(stored: DataFrame, window: int) -> DataFrame:
    """The dated sets of ``stored`` by slabs of some days, those near the end of a slab also in the next."""
    home = F.floor(F.col("day") / _span(window))
    slabs = F.when(F.floor((F.col("day") + window) / _span(window)) > home, F.array(home, home + 1)).otherwise(F.array(home))
    return stored.filter("day is not null and size > 0 and source is not null").withColumn("slab", F.explode(slabs))


def _span(window: int) -> int:
    return max(4 * window, 1)


def close_sets(stored: DataFrame, window: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``stored`` that may have a partner, stored, with the ``family`` that they share with any partner.

    The hashes of a slab are dealt into classes, by ranges, of about CELL each. Of two sets at the threshold, the parts that one
    class holds are at it too, for the whole's share is no more than the best of its parts'. So a task that compares the parts in
    one class finds the links that may be, and each hash is moved once however many sets a slab has.
    """
    fields = {f.name: f.dataType.simpleString() for f in stored.schema}
    scratch = Scratch(stored.sparkSession, "close")
    rows = _slabbed(stored, window)
    classes = rows.groupBy("slab").agg(F.ceil(F.sum(F.col("size") + ROW) / CELL).alias("classes"))
    dealt = rows.join(F.broadcast(classes), "slab").select("slab", "classes", "id", "source", "day", "h")
    dealt = dealt.mapInArrow(_dealt, f"slab long, class long, id {fields['id']}, source string, day {fields['day']}, h array<bigint>")
    links = dealt.groupBy("slab", "class").applyInArrow(_cell(window, threshold, True), f"a {fields['id']}, b {fields['id']}, score double")
    found = scratch.keep(components(links, scratch).withColumnRenamed("root", "family"), "families")
    found = F.broadcast(found) if found.count() <= BROADCAST else found
    return scratch.keep(stored.join(found, "id"), "sets")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's runs of hashes of one class, as rows of their own."""
    for batch in batches:
        sets, classes = batch.column("h"), batch.column("classes").to_numpy()
        flat = sets.flatten().to_numpy()
        row = np.repeat(np.arange(len(sets)), np.diff(sets.offsets.to_numpy()))
        kind = (((flat >> 32) + (1 << 31)) * classes[row]) >> 32
        at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]))[: len(flat)])
        runs = pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat))
        of = pa.array(row[at])
        yield pa.RecordBatch.from_pydict({"slab": batch.column("slab").take(of), "class": pa.array(kind[at]), **{c: batch.column(c).take(of) for c in ("id", "source", "day")}, "h": runs})


def _met(close: DataFrame, window: int, threshold: float, forest: bool) -> DataFrame:
    """Pairs of ``close_sets``. Families of a slab meet in bins of about CELL shingles, so a set is moved once however many partners
    it has; only a family that is larger by itself is dealt into parts, each met with each. No task holds more than two parts."""
    fields = {f.name: f.dataType.simpleString() for f in close.schema}
    rows = _slabbed(close, window)
    sizes = rows.groupBy("slab", "family").agg(F.sum(F.col("size") + ROW).alias("n"))
    bins = sizes.filter(F.col("n") <= CELL).groupBy("slab").agg(F.ceil(F.sum("n") / CELL).alias("bins"))
    large = sizes.filter(F.col("n") > CELL).select("slab", "family", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(bins), "slab", "left").join(F.broadcast(large), ["slab", "family"], "left")
    rows = rows.withColumn("bin", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("family"), F.col("bins"))).otherwise(F.xxhash64("family"))).withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("slab", "bin", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "source", "day", "h")
    return rows.groupBy("slab", "bin", "lo", "hi").applyInArrow(_cell(window, threshold, forest), f"a {fields['id']}, b {fields['id']}, score double")


def _alike(code: np.ndarray, at: np.ndarray, kinds: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Per set (its codes begin at ``at``) the first one of its source, day and codes, told by two sums of 64 bits: it has the same
    partners."""
    if not len(at):
        return at
    x, sums = code.astype(np.uint64) + np.uint64(1), []
    for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        h = x * np.uint64(k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sums.append(np.add.reduceat(h ^ (h >> np.uint64(32)), at).view(np.int64))
    _, first, group = np.unique(np.column_stack([*sums, kinds, day]), axis=0, return_index=True, return_inverse=True)
    return first[group.ravel()]


def _cell(window: int, threshold: float, forest: bool):
    """Compares the sets of one cell, of which a pair must share one of the first n - least_overlap(n) + 1 shingles of either side
    in any fixed order: rarest first, so that common phrases come last."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks()
        sets, n = column("h"), table.num_rows
        size = np.diff(sets.offsets.to_numpy())
        code = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1].astype(np.int32)
        at = np.concatenate([[0], np.cumsum(size)])
        often = np.bincount(code)
        doc = np.repeat(np.arange(n, dtype=np.int32), size)
        kinds = np.unique(np.array(column("source").to_pylist(), object), return_inverse=True)[1]
        day, slab = column("day").to_numpy(zero_copy_only=False), column("slab").to_numpy(zero_copy_only=False)
        home, dealt = day // _span(window) == slab, "part" in table.column_names
        part = column("part").to_numpy() if dealt else None
        apart = dealt and n and column("lo")[0].as_py() != column("hi")[0].as_py()
        stands = _alike(code, at[:-1], kinds, day) if forest and not apart else np.arange(n)
        order = np.lexsort((code, often[code], doc))
        code, place = code[order], np.arange(len(code)) - at[doc]
        near = np.ceil(size * threshold)
        least = np.maximum(1, np.where((near - 1) / size >= threshold, near - 1, near)).astype(np.int64)
        early = np.flatnonzero((place < (size - least + 1)[doc]) & (often[code] > 1) & (stands[doc] == doc))
        early = early[np.argsort(code[early], kind="stable")]  # by shingle, then by document
        held, end = doc[early], np.searchsorted(code[early], code[early], "right")
        mine = np.argsort(held, kind="stable")  # the entries of each document
        first = np.searchsorted(held[mine], np.arange(n + 1))
        mark, hit, root = np.zeros(len(often), bool), np.zeros(n, bool), np.arange(n)
        lefts, rights, scores = [], [], []
        for a in np.unique(held[end > np.arange(len(end)) + 1]).tolist():
            own = mine[first[a] : first[a + 1]]
            later = [held[x + 1 : end[x]] for x in own[end[own] > own + 1].tolist()]
            if sum(map(len, later)) < n:
                b = np.unique(np.concatenate(later))
            else:
                hit[:] = False
                for x in later:
                    hit[x] = True
                b = np.flatnonzero(hit)
            good = (kinds[b] != kinds[a]) & (np.abs(day[b] - day[a]) <= window) & (home[b] | home[a]) & (np.minimum(size[b], size[a]) / np.maximum(size[b], size[a]) >= threshold)
            good &= (part[b] != part[a]) if apart else True
            good &= (root[b] != root[a]) if forest else True
            b = b[good]
            mark[code[at[a] : at[a + 1]]] = True
            for some in np.array_split(b, -(-int(size[b].sum()) // STEP)) if len(b) else []:
                ends = np.cumsum(size[some])
                places = np.arange(ends[-1]) + np.repeat(at[some] - (ends - size[some]), size[some])
                both = np.add.reduceat(mark[code[places]].astype(np.int64), ends - size[some])
                score = both / (size[a] + size[some] - both)
                found = score >= threshold
                for c in (some[found] if forest else ()):
                    if root[c] != root[a]:
                        lefts.append([a])
                        rights.append([c])
                        scores.append([score[some == c][0]])
                        root[root == root[c]] = root[a]
                if not forest:
                    turned = kinds[some[found]] < kinds[a]
                    lefts.append(np.where(turned, some[found], a))
                    rights.append(np.where(turned, a, some[found]))
                    scores.append(score[found])
            mark[code[at[a] : at[a + 1]]] = False
        if forest and lefts:
            met = np.zeros(n, bool)
            met[np.array(lefts + rights).ravel()] = True
            more = np.flatnonzero(met[stands] & (stands != np.arange(n)))
            lefts, rights, scores = [*lefts, stands[more]], [*rights, more], [*scores, np.ones(len(more))]
        ids, joined = column("id"), lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
        return pa.table({"a": ids.take(pa.array(joined(lefts, np.int64))), "b": ids.take(pa.array(joined(rights, np.int64))), "score": pa.array(joined(scores, np.float64))})

    return run


def similarity(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the Jaccard similarity of their sets (id, h); an empty side gives 0."""
    a, b = sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), sets.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    rows = met.join(a, "a").join(b, "b").withColumn("both", both)
    whole = F.size("ha") + F.size("hb") - F.col("both")
    return rows.select("a", "b", F.when(F.col("both") == 0, 0.0).otherwise(F.col("both") / whole).alias("score"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): the smallest id of each connected component of ``edges`` (a, b).

    Labels move to the least of their neighbours and then to their label's label, so rounds grow with the logarithm of a
    component's length. Each round is a table in the cluster's shared folder.
    """
    either = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # ``edges`` are made once
    both = scratch.keep(edges.select(either.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("id"), "root"), "labels0")
    step = 0
    while True:
        step += 1
        least = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(least.withColumnRenamed("a", "id"), "id").select("id", F.least("root", "near").alias("next"), F.col("root").alias("old"))
        jump = moved.select(F.col("id").alias("next"), F.col("next").alias("further"))
        after = scratch.keep(moved.join(jump, "next", "left").select("id", F.least("next", F.coalesce("further", "next")).alias("root"), "old"), f"labels{step}")
        if after.filter("root <> old").isEmpty():
            return after.select("id", "root")
        labels = after.select("id", "root")


def _roots(close: DataFrame, window: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(id, root) of every document of ``close_sets`` that has a partner; the root is its component's smallest id.

    Documents of one source, day and set have the same partners, so one of them stands for all: copies in any number are as
    many rows as they have sources and days.
    """
    alike = ["source", "day", "one", "two"]
    keyed = close.select("id", "source", "day", F.xxhash64("h").alias("one"), F.xxhash64(F.lit(1), F.col("h")).alias("two"))
    keyed = keyed.join(keyed.groupBy(*alike).agg(F.min("id").alias("stands")), alike).select("id", "stands")
    keyed = scratch.keep(keyed, "alike")
    standing = close.join(keyed.filter("id = stands").select("id"), "id", "left_semi")
    roots = components(_met(standing, window, threshold, True), scratch)
    return keyed.join(roots.withColumnRenamed("id", "stands"), "stands").select("id", "root")


def _grouped(documents: DataFrame, priorities: DataFrame | None, window: int, threshold: float, scratch: Scratch, *more: str) -> tuple[DataFrame, ...]:
    """The ``close_sets`` of ``documents``, their ``_roots``, and these with source, priority, winner_id and the columns ``more``."""
    check_options(window, threshold)
    close = close_sets(scratch.keep(shingle_table(documents), "sets"), window, threshold)
    scratch.drop("sets")
    roots = scratch.keep(_roots(close, window, threshold, scratch), "roots")
    rows = documents.select("id", "source", *more).join(roots, "id")
    if priorities is not None:
        rows = rows.join(priorities.select("source", "priority"), "source", "left")
    else:
        rows = rows.withColumn("priority", F.lit(0))
    rows = scratch.keep(rows.withColumn("priority", F.coalesce("priority", F.lit(0))), "rows")
    return close, roots, with_winners(rows)


def folded(documents: DataFrame, priorities: DataFrame | None = None, window: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """``members`` for those who fold or count them, stored: group_id, id, winner, winner_id. Texts are read for their sets alone, and
    no set is compared with its winner's."""
    scratch = Scratch(documents.sparkSession, "dupes")
    rows = _grouped(documents, priorities, window, threshold, scratch)[2]
    return scratch.keep(rows.select(F.col("root").alias("group_id"), "id", (F.col("id") == F.col("winner_id")).alias("winner"), "winner_id"), "folded")


def members(documents: DataFrame, priorities: DataFrame | None = None, window: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """Members of all duplicate groups, stored: group_id, id, source, priority, winner, score, published, words, title, winner_id.

    The winner has the highest priority, then the least source, then the least id. A member's score is its similarity to
    the winner, also where only a third document linked them. Winners are found by partial aggregates and joined to their
    groups, so a group of any size is dealt over tasks.
    """
    scratch = Scratch(documents.sparkSession, "dupes")
    close, roots, rows = _grouped(documents, priorities, window, threshold, scratch, "published", "words", "title")
    sets = close.select("id", "h").join(roots.select("id"), "id", "left_semi")
    scores = similarity(rows.filter("id <> winner_id").select(F.col("winner_id").alias("a"), F.col("id").alias("b")), sets).select(F.col("b").alias("id"), "score")
    rows = rows.join(scores, "id", "left")
    made = rows.select(F.col("root").alias("group_id"), "id", "source", "priority", (F.col("id") == F.col("winner_id")).alias("winner"), F.when(F.col("id") == F.col("winner_id"), 1.0).otherwise(F.col("score")).alias("score"), "published", "words", "title", "winner_id")
    return scratch.keep(made, "members")


def with_winners(rows: DataFrame) -> DataFrame:
    """``rows`` (root, id, source, priority) with the winner_id of their root."""
    best = rows.groupBy("root").agg(F.min_by("id", F.struct(-F.col("priority"), "source", "id")).alias("winner_id"))
    return rows.join(best, "root")


def groups(member_rows: DataFrame) -> DataFrame:
    """One row a group: winner, its date, members and the lowest score of a member against the winner."""
    by = member_rows.groupBy("group_id", "winner_id")
    return by.agg(F.max(F.when(F.col("winner"), F.col("published"))).alias("published"), F.count("*").alias("members"), F.min(F.when(~F.col("winner"), F.col("score"))).alias("lowest")).orderBy("published", "winner_id")


def summary(documents: DataFrame, member_rows: DataFrame) -> DataFrame:
    """How many documents were compared (the dated ones, if there are two sources or more), and how many are in a group."""
    none = F.lit(0).cast("long")
    held = documents.agg(F.countDistinct("source").alias("sources"), F.count("published").alias("dated"))
    held = held.select(F.when(F.col("sources") > 1, F.col("dated")).otherwise(none).alias("compared"), none.alias("duplicated"), none.alias("groups"))
    found = member_rows.agg(F.countDistinct("id").alias("duplicated"), F.countDistinct("group_id").alias("groups")).select(none.alias("compared"), "duplicated", "groups")
    return held.union(found).agg(*[F.sum(c).alias(c) for c in ("compared", "duplicated", "groups")])
