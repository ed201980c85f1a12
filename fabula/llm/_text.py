"""Words and shingles of whole texts as 64-bit hashes, computed on the UTF-8 bytes of Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased where asked.
Everything is vectorised over blocks of documents; no Python string is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, beside the JVM and its next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and n + 1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; a longer text is one run."""
    if len(column) == 0:
        return
    data, offsets = utf8(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and n + 1 offsets into these for the documents."""
    inside = ~_SPACE[data]
    n = len(data)
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    new[first] = inside[first]
    starts = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_of = offsets[1:][offsets[1:] > 0] - 1
    last[ends_of] = inside[ends_of]
    ends = np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        table = _RANDOM[_LOWER] if lower else _RANDOM
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * _powers(_BASE, n), dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
        h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document its distinct k-word shingles, sorted; fewer words than k make one shingle."""
    with np.errstate(over="ignore"):
        n = len(hashes) - k + 1
        if n > 0:
            rolled = hashes[:n].copy()
            for i in range(1, k):
                rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n]
            rolled = mix64(rolled)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= k:
                yield np.unique(rolled[lo : hi - k + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                for h in hashes[lo:hi]:
                    short = short * np.uint64(0xC2B2AE3D27D4EB4F) + h
                yield mix64(np.array([short ^ np.uint64(0x5851F42D4C957F2D)]))
            else:
                yield np.zeros(0, np.uint64)


def stretched(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column with one zero byte added after each text."""
    data, offsets = utf8(column)
    size = np.diff(offsets)
    longer = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.zeros(longer[-1], np.uint8)
    place = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
    out[place] = data[offsets[0] : offsets[-1]]
    return out, longer
