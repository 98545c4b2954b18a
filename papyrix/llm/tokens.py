"""Byte-level BPE encoding with the ``tokenizers`` library, one call for the chunks of text not met before.

The vocabulary's split pattern never joins a non-space run to what follows it, and takes at most one space from before
it. Hence a text may be cut into chunks ``[ ]?non-spaces`` and white-space runs, encoded apart and joined, with the ids
of the whole text. Chunks repeat, so most are known. Cuts are made on UTF-8 bytes at ASCII spaces; texts with other white
space of the pattern's ``\\s``, or with an added token in them, are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .bytetable import SPACE, ByteTable, concat, sums

_CLOSING, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, by the installed package that describes them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks start in the bytes of texts laid end to end.

    Of a run of spaces before a word the last is cut off; it goes with the word if it is a plain space and is a chunk of
    its own if not. A run at the end of a text stays whole.
    """
    n = len(data)
    space, first = SPACE[data], np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.concatenate([[False], space[:-1]]) & ~first[:n]
    plain = np.concatenate([[False], data[:-1] == 32]) & ~first[:n]
    word_next = np.concatenate([~space[1:], [False]]) & ~first[1:]
    # Closing marks after an ASCII letter or digit begin a token run of their own.
    mark = _CLOSING[data] & np.concatenate([[False], _ALNUM[data[:-1]]])
    start = first[:n] | (~space & before & ~plain) | (space & ~before) | (space & before & word_next) | mark
    return np.flatnonzero(start)


class ChunkEncoder:
    """``encode(texts)``: for each text its ids as unsigned 32-bit integers."""

    def __init__(self, path: str, slots_log2: int = 22):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library cuts a text at added tokens before it splits it, so texts that hold one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = ByteTable(self._measure, slots_log2, "<u4")
        (self.line_feed,) = self._ids("\n")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _measure(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Chunks with words go to the library as one text of a chunk a line: a line feed between them is one token."""
        out: list = [None] * len(chunks)
        lines = []
        for i, c in enumerate(chunks):
            if c.isspace():
                out[i] = self._ids(c.decode())
            else:
                lines.append(i)
        for at in range(0, len(lines), 4096):
            some = lines[at : at + 4096]
            ids = self._ids(b"\n".join([chunks[i] for i in some]).decode())
            cuts = np.flatnonzero(ids == self.line_feed)
            if len(cuts) != len(some) - 1:
                raise ValueError("the vocabulary joins a line feed with what stands beside it")
            ends = [*cuts.tolist(), len(ids)]
            for i, a, b in zip(some, [0, *(cuts + 1).tolist()], ends):
                out[i] = ids[a:b]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i: self._ids(t) for i, t in enumerate(texts) if any(a in t for a in self.added) or not t.isascii() and _OTHER_SPACE.search(t)}
        data, bounds = concat([b"" if i in odd else t.encode() for i, t in enumerate(texts)])
        if not len(data):
            return [odd.get(i, np.zeros(0, "<u4")) for i in range(len(texts))]
        starts = chunk_starts(data, bounds[:-1][np.diff(bounds) > 0])
        ids, per_chunk = self.table.rows(self.table.numbers(data, starts, np.append(starts[1:], len(data))))
        cuts = np.concatenate([[0], np.cumsum(sums(per_chunk, np.diff(np.searchsorted(starts, bounds))))])
        return [odd[i] if i in odd else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per vocabulary and Python worker."""
    return ChunkEncoder(path)
