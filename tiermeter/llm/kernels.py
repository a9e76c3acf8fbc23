"""Vectorised text kernels over a batch of UTF-8 texts."""

from __future__ import annotations

from functools import cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: ASCII white space: bytes 9 to 13 and 32.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


@cache
def _inverse() -> int:
    return pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=U64)
    have, step = 1, base & _MASK
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(step)
        have, step = have * 2, (step * step) & _MASK
    return out


_held: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the usual batch size."""
    if len(_held.get("up", ())) < n:
        up, down = _powers(_BASE, n), _powers(_inverse(), n)
        if n > 4 << 20:
            return up, down
        _held.update(up=up, down=down)
    return _held["up"], _held["down"]


class Batch:
    """Texts joined by line feeds, with the places and hashes of their words.

    A word is a longest run of bytes other than ASCII white space. ``doc`` has
    the text's index for each word; hashes have 64 bits.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.translate(LOWER)
        self.raw = joined
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.begins = self.ends - lengths
        self.space = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(self.space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self._sums: np.ndarray | None = None

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.ends] - total[self.begins]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges [start, end)."""
        if self._sums is None:
            self._sums = np.empty(len(self.buf) + 1, dtype=U64)
            self._sums[0] = 0
            np.cumsum(_byte_values()[self.buf] * powers(len(self.buf))[0][: len(self.buf)], out=self._sums[1:])
        down = powers(len(self.buf) + 1)[1]
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U64))

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of every line, split at line feeds."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        return start, end, np.searchsorted(self.ends, start, side="left")


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of the windows of ``size`` words within one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    value = words[:n].copy()
    for k in range(1, size):
        value = value * U64(0x9FB21C651E98DF25) + words[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(value[at]), at


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its key occur twice or more; has it occurred before."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.concatenate(([False], same)) if len(key) else np.zeros(0, dtype=bool)
    many = again.copy()
    many[:-1] |= same
    twice, before = np.empty(len(key), dtype=bool), np.empty(len(key), dtype=bool)
    twice[order], before[order] = many, again
    return twice, before


def keyed(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Values made distinct between texts."""
    return mix(value ^ (doc.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
