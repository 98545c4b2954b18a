"""Word patterns and word-window counts."""

from __future__ import annotations

import re

import numpy as np

from .bytetable import sums

#: Words are runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def repeated_window_words(numbers: np.ndarray, lengths: np.ndarray, size: int = 5) -> np.ndarray:
    """Per document: words that stand in a window of ``size`` words found twice or more in it, the first included."""
    n = len(numbers)
    if n < size:
        return np.zeros(len(lengths), np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    key = doc[at].astype(np.uint64)
    for j in range(size):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + numbers[at + j].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    pair = np.flatnonzero(same)
    alike = doc[at[pair]] == doc[at[pair + 1]]
    for j in range(size):
        alike &= numbers[at[pair] + j] == numbers[at[pair + 1] + j]
    if not alike.all():  # different windows under one key: group by the windows themselves
        table = np.column_stack([doc[at], *(numbers[at + j] for j in range(size))])
        _, group, count = np.unique(table, axis=0, return_inverse=True, return_counts=True)
        twice = count[group.ravel()] > 1
    else:
        twice = np.zeros(len(at), bool)
        twice[pair] = True
        twice[pair + 1] = True
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, at[twice], 1)
    np.add.at(mark, at[twice] + size, -1)
    return sums((np.cumsum(mark[:n]) > 0).astype(np.int64), lengths)
