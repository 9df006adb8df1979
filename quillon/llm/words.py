"""Words of many texts at once, in numpy: their places, 64-bit hashes, and hashes of n-grams.

A batch of texts is one byte string with a separator after each text. A table says which bytes
belong to words, prefix sums of a polynomial give every word's hash without a loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(0x51A7)
_UNIT = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 modulo 8: powers repeat as late as they can
_BASE = (_BASE & ~7) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _table(keep, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    flags = np.array([bool(keep(b)) for b in range(256)])
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
        flags[65:91] = flags[97:123]
    return flags, to


#: Runs of digits, letters a to z after lower-casing A to Z, and everything that is not ASCII.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, True)
#: Runs of anything but space and the control characters 9 to 13, unchanged.
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13, False)

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 20), _BASE if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = have = np.multiply.accumulate(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of code units (below 1,024) that depends on its content only."""
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(_UNIT[units] * _power("up", len(units)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", len(units) + 1)[start])


@dataclass
class Words:
    """buf: the bytes after lower-casing; start, end: of each word in buf; doc: its text's number; count: words of each text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The number of each text's first word."""
        return np.concatenate(([0], np.cumsum(self.count)))

    @property
    def position(self) -> np.ndarray:
        """Each word's number within its text."""
        return np.arange(len(self.doc)) - self.first[self.doc]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words (by number) of all runs of n words within a text, and the runs' hashes."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h *= _STEP
            h += self.hash[k : k + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix(h[at])


def words(texts: list[str | None], table=ALNUM) -> Words:
    keep, to = table
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = b"\n".join([*parts, b""])
    buf = to[np.frombuffer(raw, np.uint8)] if raw else np.empty(0, np.uint8)
    edge = np.flatnonzero(np.diff(keep[buf].view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    h = span_hash(buf, start, end)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    doc = np.searchsorted(ends, start, "right")
    return Words(buf, start, end, h, doc, np.bincount(doc, minlength=len(parts)))
