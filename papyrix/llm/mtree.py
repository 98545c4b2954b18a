"""Operator 11: exact top-k inner products by best-first search of an M-tree.

Each vector x is lifted by one more coordinate, sqrt(m - |x|^2) with m the largest square length, and each query by a zero. Then
the squared distance of a query q is |q|^2 + m - 2 q.x, so the nearest vectors are those of the highest inner products, and
distances obey the triangle inequality. The tree has four levels: pivots (a bounded, fixed choice), subtrees of some thousand
vectors, pages of some dozens, vectors. Each entry of a level keeps its distance to the one above (parent distance) and how far
anything below it lies (covering radius). A subtree with its pages is one row of a table in the shared folder.

A query first searches the subtrees nearest to it, which gives it a distance that its k-th neighbour cannot exceed, and then
whatever of the tree may come closer. Within a batch of subtrees it takes pages in the order of their least possible distance.
Distances between vectors and pivots are floating-point and are widened by SLACK; scores are whole numbers, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .vectors import matrix, whole

SCALE = 64
#: Rows whose ids EVERY divides are queries; TOP neighbours of each.
EVERY, TOP = 20, 20
#: Pivots, vectors of a page and bytes of a subtree's vectors at most.
PIVOTS, PAGE, SUBTREE_BYTES = 256, 64, 1 << 19
#: Bytes of the queries that one round searches; they are sent to all tasks.
ROUND_BYTES = 1 << 23
#: Subtrees that a query searches first.
FIRST = 2
#: Of the largest length: by how much a stored distance may be off.
SLACK = 1e-5

TREE = "tree long, pivot int, centre binary, parent double, radius double, pages binary, starts binary, parents binary, radii binary, dists binary, vectors binary, own binary, ids binary, known binary"
FOUND = "query long, vec_id long, own long, score long"
_FAR = np.iinfo(np.int64).min + 1


class Space(NamedTuple):
    """How vectors of ``dim`` entries are kept (``kind``), and the largest square length of any."""

    dim: int
    most: int

    @property
    def kind(self) -> np.dtype:
        """The cheapest type in which every product and every sum of products is exact."""
        return np.dtype(np.float32 if self.most < 2**24 else np.float64 if self.most < 2**53 else np.int64)

    @property
    def slack(self) -> float:
        return SLACK * (1 + self.most**0.5)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The added coordinate."""
        return np.sqrt(np.maximum(self.most - (x.astype(np.float64) ** 2).sum(1), 0))

    def apart(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Distances between the lifted rows of ``a`` and ``b``; queries have a lift of 0."""
        a, b = a.astype(np.float64), b.astype(np.float64)
        squares = (a**2).sum(1)[:, None] + la[:, None] ** 2 + ((b**2).sum(1) + lb**2)[None, :] - 2 * (a @ b.T + np.outer(la, lb))
        return np.sqrt(np.maximum(squares, 0))

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim) if self.dim else np.zeros((0, 0), self.kind)


def _assign(space: Space, pivots: np.ndarray):
    """Rows (vec_id, own, x) to rows with the nearest pivot, the distance to it, and x as bytes."""
    lifts = space.lift(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2)).astype(space.kind)
            dists = space.apart(x, space.lift(x), pivots, lifts)
            near = dists.argmin(1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "own": batch.column(1), "pivot": pa.array(near, pa.int32()), "dist": pa.array(dists[np.arange(len(x)), near]), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def page_places(space: Space, x: np.ndarray) -> np.ndarray:
    """The page of each row: rows are halved by their distances to two far rows until no part has more than PAGE."""
    lift, place, parts, made = space.lift(x), np.zeros(len(x), np.int64), [np.arange(len(x))], 0
    while parts:
        rows = parts.pop()
        if len(rows) <= PAGE:
            place[rows] = made
            made += 1
            continue
        one = lambda i: space.apart(x[rows], lift[rows], x[[i]], lift[[i]])[:, 0]
        a = rows[one(rows[0]).argmax()]
        to_a = one(a)
        order = np.argsort(to_a - one(rows[to_a.argmax()]), kind="stable")
        half = PAGE * (-(-len(rows) // PAGE) // 2)
        parts += [rows[order[half:]], rows[order[:half]]]
    return place


def subtree(space: Space, pivots: np.ndarray, tree: int, pivot: int, ids: list, own: np.ndarray, x: np.ndarray) -> dict:
    """One row of TREE of rows that share a pivot. Routing vectors are those rows nearest to the mean, of the whole and of pages."""

    def routing(rows: np.ndarray) -> int:
        mean = x[rows].astype(np.float64).mean(0)
        return int(rows[((x[rows] - mean) ** 2).sum(1).argmin()])

    place = page_places(space, x)
    order = np.argsort(place, kind="stable")
    x, own, ids = x[order], own[order], [ids[i] for i in order]
    starts = np.searchsorted(place[order], np.arange(place.max() + 2)).astype(np.int32)
    lift = space.lift(x)
    top = routing(np.arange(len(x)))
    heads = np.array([routing(np.arange(a, b)) for a, b in zip(starts, starts[1:])])
    dists = np.concatenate([space.apart(x[a:b], lift[a:b], x[[h]], lift[[h]])[:, 0] for h, a, b in zip(heads, starts, starts[1:])])
    to_top = space.apart(x, lift, x[[top]], lift[[top]])[:, 0]
    pivot_row = pivots[[pivot]]
    raw = lambda v: v.tobytes()
    return {
        "tree": tree, "pivot": pivot, "centre": raw(x[top]), "parent": float(space.apart(x[[top]], lift[[top]], pivot_row, space.lift(pivot_row))[0, 0]), "radius": float(to_top.max()),
        "pages": raw(x[heads]), "starts": raw(starts), "parents": raw(to_top[heads]), "radii": raw(np.maximum.reduceat(dists, starts[:-1])), "dists": raw(dists),
        "vectors": raw(x), "own": raw(own), "ids": raw(np.array([i or 0 for i in ids], np.int64)), "known": raw(np.array([i is not None for i in ids])),
    }


def _builder(space: Space, pivots: np.ndarray):
    """Rows sorted by pivot to subtrees: each run of a pivot, cut where its vectors fill SUBTREE_BYTES."""
    most = max(PAGE, SUBTREE_BYTES // max(1, space.dim * space.kind.itemsize))
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[f.split()[1]]) for f in TREE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, now, held = TaskContext.get().partitionId() << 32, None, []

        def closed():
            ids, own, x = zip(*held)
            return pa.RecordBatch.from_pylist([subtree(space, pivots, number, now, list(ids), np.array(own, np.int64), np.frombuffer(b"".join(x), space.kind).reshape(len(held), space.dim))], schema)

        for batch in batches:
            for vec_id, own, pivot, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (pivot != now or len(held) == most):
                    yield closed()
                    number, held = number + 1, []
                now = pivot
                held.append((vec_id, own, x))
        if held:
            yield closed()

    return run


def build(rows: DataFrame, space: Space, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """The tree of ``rows`` (vec_id, own, x) as a table of subtrees, and its pivots.

    Rows are sorted in ranges of (pivot, distance to it, own), so that a pivot, or one vector, that holds a third of all rows is
    dealt over tasks like any others. Pivots are the PIVOTS vectors of least hash, each vector taken once.
    """
    chosen = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(PIVOTS).collect()
    pivots = np.array([r.x for r in chosen], np.int64).reshape(len(chosen), space.dim).astype(space.kind)
    near = scratch.keep(rows.select("vec_id", "own", "x").mapInArrow(_assign(space, pivots), "vec_id long, own long, pivot int, dist double, x binary"), "assigned")
    ranges = near.repartitionByRange("pivot", "dist", "own").sortWithinPartitions("pivot", "dist", "own")
    trees = ranges.select("vec_id", "own", "pivot", "x").mapInArrow(_builder(space, pivots), TREE)
    return scratch.keep(trees, "trees"), pivots


class Queries(NamedTuple):
    """The queries of a round, and of each the score that its k-th neighbour reaches at least."""

    own: np.ndarray
    x: np.ndarray
    least: np.ndarray


class Best:
    """Of each query the ``k`` best neighbours met: by score, then id (unknown ids last), then row. Places are of the round."""

    def __init__(self, queries: Queries, k: int):
        n = len(queries.own)
        self.scores, self.ids, self.own = (np.full((n, k), v, np.int64) for v in (_FAR, 0, -1))
        self.known = np.zeros((n, k), bool)
        self.least = queries.least.copy()

    def take(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray, own: np.ndarray) -> None:
        """``scores`` of queries ``q`` (rows) and vectors (columns); those of _FAR don't count."""
        some = (scores >= self.least[q][:, None]).any(1) & (scores > _FAR).any(1)
        q, scores = q[some], scores[some]
        if not len(q):
            return
        k, wide = self.scores.shape[1], np.broadcast_to
        old = (self.scores[q], self.ids[q], self.known[q], self.own[q])
        s, i, n, o = (np.hstack([a, wide(b, scores.shape)]) for a, b in zip(old, (scores, ids, known, own)))
        order = np.lexsort((o, i, ~n, -s), axis=1)[:, :k]
        self.scores[q], self.ids[q], self.known[q], self.own[q] = (np.take_along_axis(v, order, 1) for v in (s, i, n, o))
        self.least[q] = np.maximum(self.least[q], self.scores[q, k - 1])


class Search:
    """Searches batches of subtrees for the queries of a round."""

    def __init__(self, space: Space, pivots: np.ndarray, queries: Queries, k: int):
        self.space, self.q, self.best, self.k = space, queries, Best(queries, k), k
        self.x = np.ascontiguousarray(queries.x)
        self.squares = (self.x.astype(np.float64) ** 2).sum(1)
        self.to_pivots = self.to(self.x, pivots)

    def to(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return self.space.apart(x, np.zeros(len(x)), centres, self.space.lift(centres))

    def reach(self, q: np.ndarray) -> np.ndarray:
        """The distance beyond which nothing can be among the best of queries ``q``."""
        least = self.best.least[q]
        return np.where(least == _FAR, np.inf, np.sqrt(np.maximum(self.squares[q] + self.space.most - 2.0 * least, 0))) + self.space.slack

    def bounds(self, pivot: np.ndarray, parent: np.ndarray, radius: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """The least possible distance of each query (row) to each subtree: by its stored parent distance where that is enough."""
        bound = np.abs(self.to_pivots[:, pivot] - parent) - radius
        open_ = (bound <= self.reach(np.arange(len(self.x)))[:, None]).any(0)
        bound[:, open_] = np.maximum(bound[:, open_], self.to(self.x, centres[open_]) - radius[open_])
        return bound

    def subtrees(self, rows: list[dict], only: list[np.ndarray] | None = None) -> None:
        """Search ``rows`` of TREE; with ``only``, each for the queries of those places alone."""
        space = self.space
        centres = np.vstack([space.unpack(r["centre"]) for r in rows])
        bound = self.bounds(np.array([r["pivot"] for r in rows]), np.array([r["parent"] for r in rows]), np.array([r["radius"] for r in rows]), centres)
        if only is not None:
            asked = np.zeros(bound.shape, bool)
            for t, q in enumerate(only):
                asked[q, t] = True
            bound[~asked] = np.inf
        todo = bound <= self.reach(np.arange(len(self.x)))[:, None]
        queue = []  # (queries, their least possible distance, page)
        for t, row in enumerate(rows):
            q = np.flatnonzero(todo[:, t])
            if not len(q):
                continue
            starts, heads = np.frombuffer(row["starts"], np.int32), space.unpack(row["pages"])
            parents, radii = np.frombuffer(row["parents"]), np.frombuffer(row["radii"])
            vectors, dists = space.unpack(row["vectors"]), np.frombuffer(row["dists"])
            ids, known, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["own"], np.int64)
            to_centre = self.to(self.x[q], centres[[t]])
            least = np.maximum(np.abs(to_centre - parents) - radii, bound[q, t][:, None])
            near = least <= self.reach(q)[:, None]
            for p in np.flatnonzero(near.any(0)).tolist():
                mine = near[:, p]
                to_head = self.to(self.x[q[mine]], heads[[p]])[:, 0]
                span = slice(starts[p], starts[p + 1])
                queue.append((q[mine], np.maximum(least[mine, p], to_head - radii[p]), to_head, vectors[span], dists[span], ids[span], known[span], own[span]))
        if queue:
            self.pages(queue)

    def pages(self, queue: list[tuple]) -> None:
        """Each query takes the pages of ``queue`` nearest first, and ends at the first that cannot hold anything for it."""
        q = np.concatenate([p[0] for p in queue])
        least = np.concatenate([p[1] for p in queue])
        to_head = np.concatenate([p[2] for p in queue])
        page = np.repeat(np.arange(len(queue)), [len(p[0]) for p in queue])
        order = np.lexsort((least, q))
        q, least, to_head, page = q[order], least[order], to_head[order], page[order]
        first = np.concatenate([[0], 1 + np.flatnonzero(q[1:] != q[:-1])])
        at, end = first.copy(), np.append(first[1:], len(q))
        while True:
            at = np.where((at < end) & (least[np.minimum(at, len(q) - 1)] <= self.reach(q[first])), at, end)
            live = at[at < end]
            if not len(live):
                return
            live = live[np.argsort(page[live], kind="stable")]
            cuts = np.flatnonzero(np.diff(page[live])) + 1
            for some in np.split(live, cuts):
                _, _, _, vectors, dists, ids, known, own = queue[page[some[0]]]
                who = q[some]
                near = np.abs(to_head[some][:, None] - dists) <= self.reach(who)[:, None]
                used = near.any(0)
                if not used.any():
                    continue
                scores = (self.x[who] @ vectors[used].T).astype(np.int64)
                scores[~near[:, used] | (self.q.own[who][:, None] == own[used])] = _FAR
                self.best.take(who, scores, ids[used], known[used], own[used])
            at = np.where(at < end, at + 1, at)

    def found(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.best.scores > _FAR)
        ids = pa.array(self.best.ids[q, place], mask=~self.best.known[q, place])
        return pa.RecordBatch.from_pydict({"query": pa.array(q.astype(np.int64)), "vec_id": ids, "own": pa.array(self.best.own[q, place]), "score": pa.array(self.best.scores[q, place])})


def _searcher(space: Space, pivots: np.ndarray, queries: Queries, k: int, some: bool):
    """Subtrees (with ``some``, along with the queries that ask for each) to FOUND, the best of all that the task was given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(space, pivots, queries, k)
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                search.subtrees(rows, [np.array(r["asked"], np.int64) for r in rows] if some else None)
        yield search.found()

    return run


def _nearest(space: Space, pivots: np.ndarray, queries: Queries, k: int):
    """Routing entries (tree, pivot, centre, parent, radius) to the FIRST nearest of each query: (query, tree, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(space, pivots, queries, k)
        best, trees = np.full((len(queries.own), FIRST), np.inf), np.full((len(queries.own), FIRST), -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, pivot, parent, radius = (np.asarray(batch.column(c)) for c in ("tree", "pivot", "parent", "radius"))
            centres = np.vstack([space.unpack(c) for c in batch.column("centre").to_pylist()])
            # Routing vectors are vectors of their own subtrees: the nearest one's subtree is the best to begin with.
            near = np.hstack([best, search.to(search.x, centres)])
            names = np.hstack([trees, np.broadcast_to(tree, (len(best), len(tree)))])
            order = np.argsort(near, axis=1, kind="stable")[:, :FIRST]
            best, trees = np.take_along_axis(near, order, 1), np.take_along_axis(names, order, 1)
        q, place = np.nonzero(trees >= 0)
        yield pa.RecordBatch.from_pydict({"query": pa.array(q.astype(np.int64)), "tree": pa.array(trees[q, place]), "least": pa.array(best[q, place])})

    return run


def _kth(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "own")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(trees: DataFrame, pivots: np.ndarray, space: Space, queries: Queries, k: int, scratch: Scratch, name: str) -> DataFrame:
    """Rows (query, rank, vec_id, own, score) of one round, ``query`` being a place among ``queries``."""
    nearest = trees.select("tree", "pivot", "centre", "parent", "radius").mapInArrow(_nearest(space, pivots, queries, k), "query long, tree long, least double")
    order = Window.partitionBy("query").orderBy("least", "tree")
    asked = nearest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FIRST).groupBy("tree").agg(F.collect_list("query").alias("asked"))
    first = trees.join(asked, "tree").mapInArrow(_searcher(space, pivots, queries, k, True), FOUND)
    for r in _kth(first, k).filter(F.col("rank") == k).select("query", "score").collect():
        queries.least[r.query] = r.score
    return scratch.keep(_kth(trees.mapInArrow(_searcher(space, pivots, queries, k, False), FOUND), k), name)


def top_k(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, every: int = EVERY, k: int = TOP, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The ``k`` rows of highest inner product with each row whose id ``every`` divides: query_id, rank, vec_id, score.

    Scores are of vectors of whole numbers, floor(``scale`` * entry). A row is no candidate of its own, but another row with its id or
    its vector is; ties go to the smaller vec_id, null ids (which are candidates and no queries) after all others; of
    repeated ids each row is searched for and found by itself. A vector that is null or holds null, NaN or infinity takes no part,
    shorter ones are filled up with zeros, an empty table gives no rows, further columns are ignored. With fewer
    candidates than ``k`` all are returned. A table whose scores could exceed a long is an error.

    Queries are sent to tasks in rounds of ``round_bytes``; all rounds together search every query against the whole tree.
    """
    spark = prepare(rows.sparkSession)
    scratch = Scratch(spark, "mtree")
    taking = whole(rows, vector, scale, F.col(id_column).cast("long").alias("vec_id"))
    stored = scratch.keep(taking, "rows").withColumn("own", F.monotonically_increasing_id())
    stored = scratch.keep(stored, "numbered")
    square = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(18,0)") * c).cast("decimal(38,0)"))
    size = stored.agg(F.max(F.size("x")).alias("dim"), F.max(square).alias("most")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not size.dim:
        return spark.createDataFrame([], out)
    space = Space(size.dim, int(size.most))
    if space.most >= 2**63:
        raise ValueError("inner products of these vectors do not fit a long")
    trees, pivots = build(stored, space, scratch)
    asking = stored.filter(F.col("vec_id") % every == 0)
    per_round = max(1, round_bytes // (space.dim * space.kind.itemsize))
    rounds = -(-asking.count() // per_round)
    dealt = asking.withColumn("round", F.pmod(F.xxhash64("own"), F.lit(max(1, rounds))))
    dealt = scratch.keep(dealt, "queries")
    found = None
    for number in range(rounds):
        here = dealt.filter(F.col("round") == number).select("vec_id", "own", "x").collect()
        if not here:
            continue
        queries = Queries(np.array([r.own for r in here], np.int64), np.array([r.x for r in here], np.int64).astype(space.kind), np.full(len(here), _FAR, np.int64))
        names = spark.createDataFrame([(i, r.vec_id) for i, r in enumerate(here)], "query long, query_id long")
        got = search(trees, pivots, space, queries, k, scratch, f"found{number}").join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found = got if found is None else found.union(got)
    return spark.createDataFrame([], out) if found is None else found
