"""Operator 5: SentencePiece encoding and decoding with a Unigram Viterbi search over a double-array trie.

Pieces are stored as UTF-8 in a double-array trie; the best path through a text is found for many texts in step. A
character without a piece of its own becomes byte pieces. White space is marked by U+2581, one marker is put before the
text, and decoding turns markers back into spaces and drops the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetable import ByteTable, concat, sums
from .common import prepare
from .tokens import vocabulary

MARK = "▁"
#: What an unknown character costs below the least score (the usual penalty of Unigram models; a fixed value).
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie in two arrays: the child of ``s`` by byte ``c`` is ``t = base[s] + c`` if ``check[t] == s``."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, number in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][c]
            value[at] = number
        size = 2 * len(children) + 512
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken, first, wide, queue = bytearray(size), 257, 257, [(0, 0)]
        taken[0] = 1
        for node, slot in queue:  # grows while it is walked: breadth first
            self.value[slot] = value[node]
            if not (kids := sorted(children[node])):
                continue
            while taken[first]:
                first += 1
            # Only children fill the gaps that wider nodes leave; those are placed further on, not fitted from the start.
            at, probes = first if len(kids) == 1 else max(first, wide), 0
            while True:
                base = at - kids[0]
                if base + kids[-1] + 300 >= len(taken):
                    taken.extend(bytes(len(taken)))
                if not any(taken[base + c] for c in kids):
                    break
                at, probes = at + 1, probes + 1
                while taken[at]:
                    at += 1
            if len(kids) > 1:
                wide = at if probes else wide
            while base + kids[-1] >= len(self.base):
                n = len(self.base)
                self.base, self.check, self.value = (np.concatenate([a, np.full(n, f, np.int64)]) for a, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
            self.base[slot] = base
            for c in kids:
                taken[base + c] = 1
                self.check[base + c] = slot
                queue.append((children[node][c], base + c))
        end = int(np.flatnonzero(self.check >= 0).max(initial=0)) + 257
        pad = lambda a, f: np.concatenate([a, np.full(max(0, end - len(a)), f, a.dtype)])[:end]
        self.base, self.check, self.value = pad(self.base, 0), pad(self.check, -1), pad(self.value, -1)

    def find(self, key: bytes) -> int:
        """The number of ``key``, or -1."""
        at = 0
        for c in key:
            nxt = int(self.base[at]) + c
            if nxt >= len(self.check) or self.check[nxt] != at:
                return -1
            at = nxt
        return int(self.value[at])


@dataclass
class UnigramModel:
    pieces: list[str]
    scores: np.ndarray
    trie: DoubleArray
    byte_ids: np.ndarray
    unknown_id: int
    unknown_score: float
    longest: int

    def __post_init__(self):
        self.text_of = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.text_of[i] = bytes([b])


def build_model(pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int], unknown_id: int) -> UnigramModel:
    """A model from its pieces; only ``normal`` ones are matched. Without 256 byte pieces unknown characters give unknown_id."""
    # Inside, a marker is a plain space: one byte, and no other character of marked text.
    keys = {p.replace(MARK, " ").encode(): i for i, p in enumerate(pieces) if normal[i] and p}
    low = min((scores[i] for i in keys.values()), default=0.0)
    return UnigramModel(list(pieces), np.array(scores, np.float64), DoubleArray(keys), np.array(byte_ids, np.int64), unknown_id, low - UNKNOWN_PENALTY, max(map(len, keys), default=1))


def load_model(path: str, scores: str = "zipf") -> UnigramModel:
    """A public piece file. ``scores``: "model" takes the file's own; "zipf" gives the piece of rank r the log probability
    -log(r + 1) - log(H), by Zipf's law over the order in which the file ranks its pieces, for files whose scores are ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    own = [sp.get_score(i) for i in range(n)]
    if scores == "zipf":
        order = sorted((i for i in range(n) if normal[i]), key=lambda i: (-own[i], i))
        total = np.log(sum(1 / (r + 1) for r in range(len(order))))
        own = [0.0] * n
        for r, i in enumerate(order):
            own[i] = float(-np.log(r + 1) - total)
    elif scores != "model":
        raise ValueError(f"unknown scores: {scores}")
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else []
    return build_model([sp.id_to_piece(i) for i in range(n)], own, normal, byte_ids, sp.unk_id())


def _viterbi(model: UnigramModel, units: list[bytes]) -> list[np.ndarray]:
    """Best paths of units of about equal length, all in step."""
    n, longest = len(units), max(map(len, units))
    text = np.zeros((n, longest + 1), np.int64)
    for i, u in enumerate(units):
        text[i, : len(u)] = np.frombuffer(u, "u1")
    size = np.array([len(u) for u in units])
    width = np.select([text < 0x80, text < 0xC0, text < 0xE0, text < 0xF0], [1, 0, 2, 3], 4)  # of the character that starts here
    best = np.full((n, longest + 1), -np.inf)
    best[:, 0] = 0
    back, by = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
    base, check, value, scores = model.trie.base, model.trie.check, model.trie.value, model.scores
    for s in range(longest):
        rows = np.flatnonzero((s < size) & (width[:, s] > 0))
        if not len(rows):
            continue
        single, start = np.zeros(n, bool), rows
        state = np.zeros(len(rows), np.int64)
        for d in range(min(model.longest, longest - s)):
            to = base[state] + text[rows, s + d]
            ok = (check[to] == state) & (s + d < size[rows])
            rows, state = rows[ok], to[ok]
            if not len(rows):
                break
            piece = value[state]
            hit = piece >= 0
            if hit.any():
                r, p = rows[hit], piece[hit]
                got = best[r, s] + scores[p]
                up = got > best[r, s + d + 1]
                r, p = r[up], p[up]
                best[r, s + d + 1], back[r, s + d + 1], by[r, s + d + 1] = got[up], s, p
                single[rows[hit]] |= width[rows[hit], s] == d + 1
        lone = start[~single[start]]
        if len(lone):
            end = np.minimum(s + width[lone, s], size[lone])
            got = best[lone, s] + model.unknown_score
            up = got > best[lone, end]
            best[lone[up], end[up]], back[lone[up], end[up]], by[lone[up], end[up]] = got[up], s, -1
    # All paths are walked back in step; a step is a row of (piece or -1, start, end) for the texts not yet done.
    at, alive, steps = size.copy(), np.arange(n), []
    while len(alive):
        steps.append((alive, by[alive, at[alive]], back[alive, at[alive]], at[alive].copy()))
        at[alive] = steps[-1][2]
        alive = alive[at[alive] > 0]
    who, piece, start, end = (np.concatenate(x[::-1]) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 4
    order = np.argsort(who, kind="stable")  # steps were turned round, so each text's own run from its start
    who, piece, start, end = who[order], piece[order], start[order], end[order]
    piece, times = _with_bytes(model, piece, start, end, lambda w, i: text[who[w], i])
    return np.split(piece, np.cumsum(np.bincount(who, weights=times, minlength=n).astype(np.int64))[:-1])


def _with_bytes(model: UnigramModel, piece: np.ndarray, start: np.ndarray, end: np.ndarray, byte_at) -> tuple[np.ndarray, np.ndarray]:
    """The ids of path steps and how many each has, -1 being an unknown character: its byte pieces, or the unknown id."""
    times, lone = np.ones(len(piece), np.int64), piece < 0
    if lone.any() and len(model.byte_ids):
        times = np.where(lone, end - start, 1)
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        step, piece, lone = np.repeat(np.arange(len(times)), times), np.repeat(piece, times), np.repeat(lone, times)
        piece[lone] = model.byte_ids[byte_at(step[lone], (start[step] + within)[lone])]
    return np.where(piece < 0, model.unknown_id, piece).astype("<i4"), times


#: Bytes of a unit from which it is searched alone, and those whose matches are found at once.
LONG_UNIT, MATCHED = 96, 1 << 16


def _matches(model: UnigramModel, text: np.ndarray, width: np.ndarray, first: int, last: int):
    """Steps (start, end, piece or -1) that begin at the bytes from ``first`` to ``last``, by start, short pieces first."""
    base, check, value = model.trie.base, model.trie.check, model.trie.value
    starts = first + np.flatnonzero(width[first:last] > 0)
    rows, state, single = starts, np.zeros(len(starts), np.int64), np.zeros(last - first, bool)
    found = []
    for d in range(model.longest):
        on = rows + d < len(text)
        rows, state = rows[on], state[on]
        to = base[state] + text[rows + d]
        ok = check[to] == state
        rows, state = rows[ok], to[ok]
        if not len(rows):
            break
        hit = value[state] >= 0
        at = rows[hit]
        found.append((at, np.full(len(at), d + 1), value[state[hit]]))
        single[at[width[at] == d + 1] - first] = True
    lone = starts[~single[starts - first]]
    found.append((lone, np.minimum(width[lone], len(text) - lone), np.full(len(lone), -1)))
    start, length, piece = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    return start[order], start[order] + length[order], piece[order]


def _long_path(model: UnigramModel, unit: bytes) -> np.ndarray:
    """The best path of one long unit, as of a script without spaces: matches are found for many places at once, and each is
    looked at once, so the time grows with the length alone."""
    text = np.frombuffer(unit, "u1").astype(np.int64)
    n = len(text)
    width = np.select([text < 0x80, text < 0xC0, text < 0xE0, text < 0xF0], [1, 0, 2, 3], 4)
    best, back, by = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
    best[0] = 0.0
    scores = np.append(model.scores, model.unknown_score)  # -1 is the last
    for first in range(0, n, MATCHED):
        last = min(n, first + MATCHED)
        start, end, piece = _matches(model, text, width, first, last)
        reach = min(n, last + max(model.longest, 4)) + 1
        top, came, what = best[first:reach].tolist(), back[first:reach].tolist(), by[first:reach].tolist()
        for s, e, p, score in zip((start - first).tolist(), (end - first).tolist(), piece.tolist(), scores[piece].tolist()):
            got = top[s] + score
            if got > top[e]:
                top[e], came[e], what[e] = got, s + first, p
        best[first:reach], back[first:reach], by[first:reach] = top, came, what
    ends, at, before = [], n, memoryview(back)
    while at > 0:
        ends.append(at)
        at = before[at]
    end = np.array(ends[::-1], np.int64)
    return _with_bytes(model, by[end].astype(np.int64), back[end].astype(np.int64), end, lambda step, i: text[i])[0]


def viterbi_units(model: UnigramModel, units: list[bytes]) -> list[np.ndarray]:
    """Ids of each unit; short units are grouped by length, so that a long one pads no short ones."""
    out: list[np.ndarray] = [_long_path(model, u) if len(u) > LONG_UNIT else None for u in units]  # type: ignore[list-item]
    order = sorted((i for i, u in enumerate(units) if len(u) <= LONG_UNIT), key=lambda i: len(units[i]))
    at = 0
    while at < len(order):
        cap = max(1, len(units[order[at]])) * 1.3 + 2
        upto = at
        while upto < len(order) and len(units[order[upto]]) <= cap and upto - at < max(1, 4_000_000 // int(cap)):
            upto += 1
        group = order[at:upto]
        for i, ids in zip(group, _viterbi(model, [units[i] for i in group])):
            out[i] = ids
        at = upto
    return out


def marked(text: str) -> bytes:
    """The text with its marker in front, markers being plain spaces; nothing for an empty text."""
    return (" " + text.replace(MARK, " ")).encode() if text else b""


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Pieces hold markers at their start only, so a text falls apart before a marker that follows something else."""
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    mark = data == 32
    return np.flatnonzero(first[:-1] | (mark & ~np.concatenate([[False], mark[:-1]])))


def encode_marked(texts: list[bytes], numbers) -> tuple[np.ndarray, np.ndarray]:
    """The ids of marked texts end to end, and how many each has; ``numbers`` is a table over units."""
    data, bounds = concat(texts)
    if not len(data):
        return np.zeros(0, "<i4"), np.zeros(len(texts), np.int64)
    starts = unit_starts(data, bounds[:-1][np.diff(bounds) > 0])
    ids, per_unit = numbers.rows(numbers.numbers(data, starts, np.append(starts[1:], len(data))))
    return ids, sums(per_unit, np.diff(np.searchsorted(starts, bounds)))


def encode(model: UnigramModel, texts: list[str]) -> list[np.ndarray]:
    table = ByteTable(lambda units: viterbi_units(model, units), 16)
    ids, count = encode_marked([marked(t) for t in texts], table)
    return np.split(ids, np.cumsum(count)[:-1])


def decode(model: UnigramModel, ids) -> str:
    """The text of ids: byte pieces as bytes, markers as spaces, the first marker dropped."""
    raw = b"".join(map(model.text_of.__getitem__, ids))
    return raw[1:].decode("utf-8", "replace") if raw.startswith(b" ") else raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _loaded(path: str, scores: str) -> tuple[UnigramModel, ByteTable]:
    model = load_model(path, scores)
    return model, ByteTable(lambda units: viterbi_units(model, units), 21)


ENCODED = "doc_id long, n_tokens long, n_byte_tokens long, score double, ids_crc32 long, round_trip boolean, ids binary"


def _coder(path: str, scores: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _loaded(path, scores)
        is_byte = np.zeros(len(model.pieces), np.int64)
        is_byte[model.byte_ids] = 1
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, n_tokens = encode_marked([marked(t) for t in texts], table)
            ends = np.cumsum(n_tokens)
            parts = [ids[e - n : e] for e, n in zip(ends.tolist(), n_tokens.tolist())]
            raw = [p.astype("<u4").tobytes() for p in parts]
            back = [decode(model, p.tolist()) == t.replace(MARK, " ") for p, t in zip(parts, texts)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_tokens": pa.array(n_tokens), "n_byte_tokens": pa.array(sums(is_byte[ids], n_tokens)),
                "score": pa.array(np.round(sums(np.where(is_byte[ids] == 1, 0.0, model.scores[ids]), n_tokens), 4)), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                "round_trip": pa.array(back, pa.bool_()), "ids": pa.array(raw if with_ids else [None] * len(raw), pa.binary()),
            })

    return run


def encode_documents(docs: DataFrame, vocab: str | None = None, scores: str = "zipf", with_ids: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): the ids (little-endian unsigned 32-bit), their
    number, those of the byte fallback, the sum of the scores of the other pieces, a CRC-32 of the ids, and whether they
    decode to the text (a U+2581 in the text itself comes back as a space, as in the format). Null and empty texts have
    no ids. Texts of any length are encoded whole. Of paths of one score the one stays whose last piece begins first, and so on from
    the end. Repeated rows give repeated results; an empty table gives no rows."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_coder(vocab or vocabulary("piece_bpe_32k.model"), scores, with_ids), ENCODED)
