"""Spans of bytes to numbers and to ragged integer rows, for a whole batch at once.

Most words of a corpus repeat, so each distinct span is measured once and looked up afterwards. Spans are known by 96 bits
of hash, in an open-addressing table of numpy arrays: an entry costs some thirty bytes and a batch needs no Python loop.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = mix((np.arange(1 << 12, dtype=np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)


def _multipliers(place: np.ndarray) -> np.ndarray:
    if len(place) and int(place.max()) >= len(_PLACES):
        return mix((place.astype(np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)
    return _PLACES[place]


def concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text starts (with the end after them)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


#: Bytes that are hashed at once: bounds the working memory, some thirty bytes for each.
HASHED_AT_ONCE = 1 << 21


def _span_sums(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each span the sum of its bytes weighted by their place."""
    sums, total = np.zeros(len(lens), np.uint64), int(lens.sum())
    if not total:
        return sums
    first = np.cumsum(lens) - lens
    if total == len(data):
        inside = data
    else:
        cover, some = np.zeros(len(data) + 1, np.int8), lens > 0
        cover[starts[some]] += 1
        np.subtract.at(cover, (starts + lens)[some], 1)
        inside = data[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)]
    place = np.arange(total) - np.repeat(first, lens)
    terms = (inside.astype(np.uint64) + np.uint64(1)) * _multipliers(place)
    some = np.flatnonzero(lens)
    sums[some] = np.add.reduceat(terms, first[some])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending spans that do not overlap: sums of bytes weighted by their place in the span."""
    lens = ends - starts
    sums, at = np.zeros(len(lens), np.uint64), 0
    while at < len(lens):
        if lens[at] > HASHED_AT_ONCE:  # a span of its own, by parts
            for off in range(0, int(lens[at]), HASHED_AT_ONCE):
                part = data[starts[at] + off : min(starts[at] + off + HASHED_AT_ONCE, ends[at])].astype(np.uint64) + np.uint64(1)
                sums[at : at + 1] += (part * _multipliers(off + np.arange(len(part)))).sum(dtype=np.uint64)
            at += 1
            continue
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED_AT_ONCE, side="right")))
        low = int(starts[at])
        sums[at:upto] = _span_sums(data[low : int(ends[upto - 1])], starts[at:upto] - low, lens[at:upto])
        at = upto
    return mix(sums + lens.astype(np.uint64) * _ODD)


class ByteTable:
    """``measure(spans)`` gives an integer row for each distinct span; ``numbers`` and ``rows`` serve whole batches.

    When ``limit`` spans are known the table starts anew: that costs time and never changes a result, for numbers are
    only compared within one batch. A batch of more spans than that makes the table grow until it starts anew.
    """

    #: Spans that are measured at once.
    PART = 1 << 18

    def __init__(self, measure: Callable[[list[bytes]], list[np.ndarray]], slots_log2: int = 22, dtype="<i4"):
        self.measure, self.least, self.dtype = measure, 1 << slots_log2, dtype
        self.limit = int(self.least * 0.6)
        self._clear()

    def _clear(self) -> None:
        self.slots = self.least
        self.keys, self.number = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        self.check = np.zeros(self.slots, np.uint32)
        self.starts, self.lens, self.flat = np.zeros(4096, np.int64), np.zeros(4096, np.int32), np.zeros(1 << 14, self.dtype)
        self.count = self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)])

    def _find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of known spans, -1 for others."""
        mask = np.uint64(self.slots - 1)
        out = np.full(len(keys), -1, np.int64)
        slot, left = (keys & mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            number = self.number[slot]
            hit = (self.keys[slot] == keys[left]) & (self.check[slot] == check[left]) & (number >= 0)
            out[left[hit]] = number[hit]
            on = ~hit & (number >= 0)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, keys: np.ndarray, check: np.ndarray, numbers: np.ndarray) -> None:
        slot, left = (keys & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.number[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            here = free[first]
            at, who = slot[here], left[here]
            self.keys[at], self.check[at], self.number[at] = keys[who], check[who], numbers[who]
            on = np.ones(len(left), bool)
            on[here] = False
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of ascending spans of ``data``; equal spans have equal numbers within one call."""
        if not len(starts):
            return np.zeros(0, np.int64)
        keys = span_hashes(data, starts, ends)
        edge = (data[np.minimum(starts, len(data) - 1)].astype(np.uint32) << np.uint32(8)) | data[np.maximum(ends - 1, 0)]
        check = (edge << np.uint32(16)) ^ (ends - starts).astype(np.uint32)
        out = self._find(keys, check)
        new = np.flatnonzero(out < 0)
        if len(new):
            if self.count + len(new) > self.limit and self.count:  # at worst all are distinct
                distinct = len(np.unique(keys[new]))
                if self.count + distinct > self.limit:
                    self._clear()
                    new = np.arange(len(keys))
            _, first = np.unique(keys[new], return_index=True)
            self._learn(data, starts, ends, keys, check, new[first])
            out[new] = self._find(keys[new], check[new])
            while (still := np.flatnonzero(out < 0)).size:  # equal keys of different spans: one at a time
                self._learn(data, starts, ends, keys, check, still[:1])
                out[still] = self._find(keys[still], check[still])
        return out

    def _grow(self, n: int) -> None:
        """Room for ``n`` spans, those known being put in their new places."""
        used = np.flatnonzero(self.number >= 0)
        held = self.keys[used], self.check[used], self.number[used]
        while n > 0.6 * self.slots:
            self.slots *= 2
        self.keys, self.number = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        self.check = np.zeros(self.slots, np.uint32)
        self._insert(*held)

    def _learn(self, data, starts, ends, keys, check, which) -> None:
        if len(which) > self.PART:
            for at in range(0, len(which), self.PART):
                self._learn(data, starts, ends, keys, check, which[at : at + self.PART])
            return
        raw = data.tobytes() if len(which) > 64 else data
        spans = [bytes(raw[s:e]) for s, e in zip(starts[which].tolist(), ends[which].tolist())]
        rows = self.measure(spans)
        lens = np.array([len(r) for r in rows], np.int64)
        total, n = int(lens.sum()), len(which)
        if self.count + n > 0.9 * self.slots:
            self._grow(self.count + n)
        self.starts, self.lens, self.flat = self._room(self.starts, self.count + n), self._room(self.lens, self.count + n), self._room(self.flat, self.used + total)
        self.lens[self.count : self.count + n] = lens
        self.starts[self.count : self.count + n] = self.used + np.cumsum(lens) - lens
        if total:
            self.flat[self.used : self.used + total] = np.concatenate(rows)
        self._insert(keys[which], check[which], np.arange(self.count, self.count + n))
        self.count, self.used = self.count + n, self.used + total

    def rows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of these spans end to end, and the length of each."""
        lens = self.lens[numbers].astype(np.int64)
        ends = np.cumsum(lens)
        at = np.repeat(self.starts[numbers] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], lens


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (0 for empty runs)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text (runs of anything but the six ASCII spaces), and words a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate([[True], space[:-1]]) | cut[:-1]
    after = np.concatenate([space[1:], [True]]) | cut[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))
