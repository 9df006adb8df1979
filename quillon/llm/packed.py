"""A membership exchange between units of documents, in packed form.

A unit sends the sorted hashes it wants to ask about, cut into parts by their leading bits and packed as
differences; the task of a part sees every unit's hashes of that range and answers. A hash crosses the
network once for each unit that has it, however often it occurs there, so a common hash makes no hot task.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<QIB")


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as byte planes of their differences, compressed."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.uint64))
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 0
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, :width].T if width else gaps
    return _HEAD.pack(int(values[0]), len(values), width) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    first, n, width = _HEAD.unpack_from(blob)
    out = np.zeros(n, np.uint64)
    if n > 1:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[_HEAD.size :], max_output_size=(n - 1) * width), np.uint8)
        gaps = np.zeros((n - 1, 8), np.uint8)
        gaps[:, :width] = planes.reshape(width, n - 1).T
        out[1:] = gaps.view(np.uint64).ravel()
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def plain(values: np.ndarray) -> bytes:
    """Numbers in any order, as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes())


def unplain(blob: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit hash; ascending hashes have ascending parts."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def cuts(h: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of each part that has some of the ascending hashes."""
    p = part_of(h, parts)
    at = np.flatnonzero(np.diff(p, prepend=-1))
    return list(zip(p[at].astype(int).tolist(), at.tolist(), [*at[1:].tolist(), len(h)])) if len(h) else []
