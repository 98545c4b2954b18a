"""Top-k search, prefix trie and whitening against brute force, on fixtures with every odd row."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from papyrix.llm import mtree, prefix_trie, whitening
from papyrix.llm.common import Scratch

NAN, INF = float("nan"), float("inf")
ODD = [(0, None), (20, [1.0, None, 2.0]), (40, [NAN, 1.0, 0.0]), (60, [INF, 1.0, 0.0]), (None, [0.5, 0.25, 0.125]), (80, [-0.0, 0.0, 0.0]), (3, []), (100, [1.0, 1.0])]
SCHEMA = "vec_id long, embedding array<float>, x string, own string, pivot string, n string"


def framed(spark, rows):
    """With columns of other meaning that bear the names the operators use inside."""
    return spark.createDataFrame([(i, v, "x", "own", "pivot", "n") for i, v in rows], SCHEMA).repartition(3)


def near_and_far(n=600, dim=3, seed=3):
    """Groups of near vectors, one vector a third of all, repeated ids, and the odd rows."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(9, dim))
    rows = [(int(i), (middles[i % 9] + 0.05 * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.25] * dim) for i in range(n // 2)]
    return rows + [rows[20], rows[20], rows[41]] + ODD


def whole(rows, scale):
    """The rows that take part: ids and a matrix."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    most = max((len(v) for _, v in good), default=0)
    x = np.array([np.floor(scale * np.array([*v, *[0.0] * (most - len(v))], np.float32).astype(np.float64)) for _, v in good]).reshape(len(good), most) + 0
    return [i for i, _ in good], x.astype(np.int64)


def best(rows, k, every=20):
    ids, x = whole(rows, 64)
    out = []
    for a, q in enumerate(ids):
        if q is None or q % every:
            continue
        others = sorted((-int(x[a] @ x[b]), ids[b] is None, ids[b] or 0) for b in range(len(ids)) if b != a)[:k]
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(others, 1)]
    return out


def same(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_top_k(spark):
    rows = near_and_far()
    same(mtree.top_k(framed(spark, rows)).collect(), best(rows, 20))


def test_top_k_in_rounds_and_pages(spark, monkeypatch):
    """Small subtrees, and rounds of two queries each, of vectors with more and larger entries."""
    monkeypatch.setattr(mtree, "SUBTREE_BYTES", 64 * 16 * 5)
    rows = [(i, [400 * c for c in v or []] or v) if v is None or None not in v else (i, v) for i, v in near_and_far(300, 5, 4)]
    got = mtree.top_k(framed(spark, rows), k=7, round_bytes=8 * 5 * 2).collect()
    same(got, best(rows, 7))


@pytest.mark.parametrize("factor", [1e6, 1e7])
def test_top_k_of_large_entries(spark, factor):
    """Products beyond what floats, then doubles, hold exactly."""
    rows = [(i, [factor * c for c in v]) for i, v in near_and_far(120, 3)[:150] if v]
    same(mtree.top_k(framed(spark, rows), k=5).collect(), best(rows, 5))


def test_top_k_that_no_long_holds(spark):
    with pytest.raises(ValueError, match="long"):
        mtree.top_k(framed(spark, [(20, [1e9, 1e9])]))


def test_top_k_of_few_and_none(spark):
    few = [(20, [1.0, 2.0]), (2, [0.5, 0.5]), (40, None)]
    same(mtree.top_k(framed(spark, few)).collect(), best(few, 20))
    for rows in ([], ODD[:4], [(20, [1.0])], [(7, [1.0]), (8, [2.0])]):
        assert mtree.top_k(framed(spark, rows)).collect() == []


def test_tree_bounds_hold(spark):
    """Each vector is in one page; radii cover it and parent distances are right, so that what is passed over is far enough."""
    r = np.random.default_rng(1)
    space = mtree.Space(8, 0)
    x = np.floor(r.normal(size=(700, 8)) * 20).astype(np.int64)
    space = mtree.Space(8, int((x**2).sum(1).max()))
    x = x.astype(space.kind)
    row = mtree.subtree(space, x[:5], 0, 2, list(range(700)), np.arange(700), x)
    got, starts = space.unpack(row["vectors"]), np.frombuffer(row["starts"], np.int32)
    own, heads, radii, dists = np.frombuffer(row["own"], np.int64), space.unpack(row["pages"]), np.frombuffer(row["radii"]), np.frombuffer(row["dists"])
    assert sorted(own) == list(range(700)) and (got == x[own]).all() and np.diff(starts).max() <= mtree.PAGE
    lift = space.lift(got)
    for p, (a, b) in enumerate(zip(starts, starts[1:])):
        d = space.apart(got[a:b], lift[a:b], heads[[p]], space.lift(heads[[p]]))[:, 0]
        assert np.abs(d - dists[a:b]).max() < space.slack and d.max() <= radii[p] + space.slack
    centre = space.unpack(row["centre"])
    assert space.apart(got, lift, centre, space.lift(centre)).max() <= row["radius"] + space.slack


def test_bounds_avoid_work(spark):
    """Queries in groups that lie apart compute a small part of all products."""
    r = np.random.default_rng(2)
    x = np.floor((np.repeat(np.eye(16) * 60, 64, 0) + r.normal(size=(1024, 16))) * 4).astype(np.int64)
    space = mtree.Space(16, int((x**2).sum(1).max()))
    x = x.astype(space.kind)
    rows = [mtree.subtree(space, x[::64], t, t, list(range(64)), np.arange(64 * t, 64 * t + 64), x[64 * t : 64 * t + 64]) for t in range(16)]
    queries = mtree.Queries(np.array([5, 700]), x[[5, 700]], np.full(2, mtree._FAR, np.int64))
    search = mtree.Search(space, x[::64], queries, 10)
    computed, take = [], search.best.take
    search.best.take = lambda q, scores, *rest: (computed.append(scores.size), take(q, scores, *rest))
    search.subtrees(rows)
    want = np.sort(x @ x[5])[::-1]
    assert search.best.scores[0].tolist() == np.sort(np.delete(x @ x[5], 5))[::-1][:10].tolist() and len(want)
    assert sum(computed) <= 2 * 1024 / 4


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()), (r, x)))
    turns = {c: [y for _, y in sorted(v, key=lambda z: z[0])] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built = tuple(turns.get(first, [])[:h] + own[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    children, leaves, saved = (defaultdict(int) for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest(k)) for k, m in members.items()]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos long").repartition(3)


TALK = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c // 40}") for c in range(-7, 90) for t in range(c % 7)]
TALK += [(c, t, "user", "the same ü") for c in range(200, 260) for t in range(9)]
TALK += [(300, None, None, None), (300, None, "a", None), (300, 1, None, "x"), (301, 1, "", "x"), (301, 1, "x", ""), (None, 1, "user", "lost"), (302, 2, "r", "same"), (302, 2, "r", "same"), (302, 2, "q", "other"), (303, 1, "u", "long " * 30000)]


def test_trie(spark):
    same(prefix_trie.prefix_trie(conversations(spark, TALK)).collect(), brute_trie(TALK))


def test_trie_of_one_long_conversation(spark, monkeypatch):
    """Deeper than three levels of runs, beside copies that end at and around the ends of runs."""
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    rows = [(c, t, "u", f"t{t}") for c, n in ((5, 300), (10, 4), (15, 3), (20, 5), (25, 16), (30, 64), (35, 65), (41, 70), (45, 256)) for t in range(n)]
    same(prefix_trie.prefix_trie(conversations(spark, rows)).collect(), brute_trie(rows))


def test_trie_of_copies(spark, monkeypatch):
    """One conversation in hundreds of copies, its ids in many pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows = [(c, t, "u", f"t{t}") for c in range(0, 2000, 5) for t in range(3)]
    same(prefix_trie.prefix_trie(conversations(spark, rows)).collect(), brute_trie(rows))


def test_empty_trie(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "u", "x")])).collect() == []


def test_whitening(spark):
    rows = near_and_far(dim=5)
    ids, x = whole(rows, 256)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - sums / n) @ vectors[:, :4] / np.sqrt(values[:4])
    got = whitening.whiten(framed(spark, rows)).collect()
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for c in range(1, 5):
        mine = sorted(((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == c))
        theirs = sorted((i is None, i or 0, int(((n * v - sums) ** 2).sum()), w) for i, v, w in zip(ids, x, want[:, c - 1]))
        assert [m[:3] for m in mine] == [t[:3] for t in theirs]
        a, b = np.array([m[3] for m in mine]), np.array([t[3] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert [r.explained for r in got if r.component == c][:1] == pytest.approx([values[c - 1] / values.sum()])


def test_factors_merge_to_one(spark):
    """A tree of several levels gives the factor of all rows, up to signs."""
    r = np.random.default_rng(5)
    x = r.integers(-90, 90, (500, 6))
    sums, fit = x.sum(0).tolist(), spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(70)
    got = whitening.last_factor(fit, 500, sums, Scratch(spark, "test"))
    want = x - x.mean(0)
    assert np.abs(got.T @ got - want.T @ want).max() < 1e-6 * np.abs(want.T @ want).max()


def test_whitening_where_nothing_varies(spark):
    assert whitening.whiten(framed(spark, [])).collect() == whitening.whiten(framed(spark, ODD[:4])).collect() == []
    got = whitening.whiten(framed(spark, [(1, [0.5, 0.25])] * 3)).collect()
    assert len(got) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got)
    line = sorted(whitening.whiten(framed(spark, [(1, [0.5, 1.0]), (2, [0.25, 0.5])])).collect())
    assert [(r.component, r.whitened is None, round(r.explained, 9)) for r in line] == [(1, False, 1.0), (2, True, 0.0)] * 2
    assert [abs(r.whitened) for r in line if r.component == 1] == pytest.approx([1, 1]) and line[0].identity_error < 1e-9


def test_deviation_that_no_long_holds(spark):
    got = whitening.whiten(framed(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 256**2} and all(r.whitened is not None for r in got)
