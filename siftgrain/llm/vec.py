"""Vectorised text kernels on Arrow buffers: words, shingles and rolling hashes.

All kernels see UTF-8 bytes. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D. Hashes are 64 bits wide; polynomial sums over random byte
values are shifted to position zero by powers of the inverse base, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = [U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
STEP = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, kept for the life of the worker."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + (SLICE >> 1))
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * MIX[0]
    h = (h ^ (h >> U(33))) * MIX[1]
    return h ^ (h >> U(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; a longer row comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of a run of rows: start, end, row and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        if lower:
            data = LOWER[data]
        self.data, self.offsets, n = data, offsets, len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~SPACE[data]
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1]
        edges = offsets[:-1][offsets[:-1] < n]
        begins[edges] |= inside[edges]
        ends = inside[:n] & ~inside[1:]
        edges = offsets[1:][offsets[1:] > 0] - 1
        ends[edges] |= inside[edges]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``width`` words inside a row."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h = (h ^ (h >> U(29))) * STEP[i % 4] + self.hash[i : i + n] * STEP[(i + 1) % 4]
        first = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return first, mix(h[first])


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Unmixed hash of each byte window; windows may cross rows."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=sums[1:])
    return (sums[width:] - sums[: n - width + 1]) * down[: n - width + 1]
