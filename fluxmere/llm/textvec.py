"""Vectorised words of whole texts: numpy over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its 64-bit hash is a
polynomial over a random byte table, so the hash of any byte range comes from two prefix
sums; the result is finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; numpy's columns take some forty times as much.
CHUNK_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("_POW", _BASE), ("_INV", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of some consecutive rows: byte range, row and hash of each, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        self.rows = len(offsets) - 1
        solid = ~_SPACE[data]
        first = np.ones(n, bool)
        last = np.ones(n, bool)
        if n:
            first[1:] = ~solid[:-1]
            last[:-1] = ~solid[1:]
            bounds = offsets[1:-1]
            first[bounds[bounds < n]] = True
            last[bounds[bounds > 0] - 1] = True
        self.start = np.flatnonzero(solid & first)
        self.end = np.flatnonzero(solid & last) + 1
        power, self._inverse = _powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * power[:n], out=self._sums[1:])
        self.row = np.searchsorted(offsets[1:], self.start, "right")
        #: words of row r are first[r]:first[r + 1]
        self.first = np.searchsorted(self.start, offsets, "left")

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Of the words, or of their first ``prefix`` bytes."""
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        raw = (self._sums[end] - self._sums[self.start]) * self._inverse[self.start]
        return mix(raw + (end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, Words]]:
    """(first row, Words) of pieces of a column with about CHUNK_BYTES each; rows stay whole."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, Words(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], lower)
        row = to


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words make one run, none none."""
    n = len(hashes)
    if n == 0:
        return hashes[:0]
    span = min(size, n)
    out = np.full(n - span + 1, np.uint64(span), np.uint64)
    for k in range(span):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - span + 1 + k])
    return np.unique(out)
