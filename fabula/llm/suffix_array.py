"""Suffix sorting by induction over disk-backed bucket queues.

The queue of (first symbol, arrival) tuples is a priority queue: symbols are taken in order, and
within a symbol suffixes come in the order they were induced. Whole batches of equal priority are
handled at once as numpy arrays; a queue writes what exceeds its memory to a temporary file.

Induction runs twice: first over unordered left-most-S positions, which sorts the substrings between
them; these become the symbols of a shorter text, whose suffixes are ranked by doubling up to
``depth`` text symbols; then over the ranked positions, which sorts all suffixes. Suffixes that agree
on ``depth`` symbols may come in any order, but stand together.
"""

from __future__ import annotations

import tempfile

import numpy as np


class BucketQueues:
    """First-in-first-out queues of position arrays, one for each symbol, spilled beyond ``memory`` bytes."""

    def __init__(self, symbols: int, memory: int):
        self.chunks: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file, self.end = memory, 0, None, 0

    def push(self, symbol: int, positions: np.ndarray) -> None:
        self.chunks[symbol].append(positions)
        self.held += positions.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """What is held goes to the file, one piece a queue, after what is there of it."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # without a name: it goes with the process
        self.file.seek(self.end)
        for queue in self.chunks:
            held = [chunk for chunk in queue if isinstance(chunk, np.ndarray)]
            if held:
                whole = np.concatenate(held)
                queue[-len(held) :] = [(self.end, len(whole), whole.dtype)]
                self.end += self.file.write(whole.tobytes())
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        out = []
        for chunk in self.chunks[symbol]:
            if isinstance(chunk, tuple):
                at, n, dtype = chunk
                self.file.seek(at)
                chunk = np.frombuffer(self.file.read(n * dtype.itemsize), dtype)
            else:
                self.held -= chunk.nbytes
            out.append(chunk)
        self.chunks[symbol] = []
        return np.concatenate(out) if out else None

    def scatter(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Push positions by symbol, keeping their order."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        ranked = symbols[order]
        cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
        for part in np.split(order, cuts):
            self.push(int(symbols[part[0]]), positions[part])


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than the next one; the end of the text is smaller than any symbol."""
    n = len(text)
    last = np.flatnonzero(np.concatenate((text[1:] != text[:-1], [True])))
    rising = np.zeros(len(last), bool)
    rising[:-1] = text[last[:-1]] < text[last[:-1] + 1]
    return np.repeat(rising, np.diff(np.concatenate(([-1], last)))) if n else np.zeros(0, bool)


def induce(text: np.ndarray, stype: np.ndarray, lms: list[np.ndarray | None], symbols: int, memory: int) -> tuple[list, list]:
    """Sorted L-type and S-type positions of every symbol from left-most-S positions in each."""
    n = len(text)
    queues = BucketQueues(symbols, memory)
    larger: list[np.ndarray | None] = [None] * symbols
    empty = np.zeros(0, np.int32)
    queues.push(int(text[n - 1]), np.array([n - 1], np.int32))  # induced by the end of the text, always L-type
    for c in range(symbols):
        batches = []
        batch = queues.pop(c)
        while batch is not None and len(batch):
            batches.append(batch)
            before = batch[batch > 0] - 1
            before = before[~stype[before]]
            same = text[before] == c
            queues.scatter(text[before[~same]], before[~same])
            batch = before[same]
        larger[c] = np.concatenate(batches) if batches else empty
        if lms[c] is not None:
            before = lms[c][lms[c] > 0] - 1
            queues.scatter(text[before], before)
    smaller: list[np.ndarray | None] = [None] * symbols
    queues = BucketQueues(symbols, memory)
    for c in range(symbols - 1, -1, -1):
        batches = []
        batch = queues.pop(c)
        while batch is not None and len(batch):
            batches.append(batch)
            before = batch[batch > 0] - 1
            before = before[stype[before]]
            same = text[before] == c
            queues.scatter(text[before[~same]], before[~same])
            batch = before[same]
        smaller[c] = (np.concatenate(batches) if batches else empty)[::-1]
        before = larger[c][::-1]
        before = before[before > 0] - 1
        before = before[stype[before]]
        queues.scatter(text[before], before)
    return larger, smaller


def _by_symbol(text: np.ndarray, positions: np.ndarray, symbols: int) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = [None] * symbols
    order = np.argsort(text[positions], kind="stable")
    ranked = positions[order]
    if len(ranked):
        for part in np.split(ranked, np.flatnonzero(np.diff(text[ranked].astype(np.int32))) + 1):
            out[int(text[part[0]])] = part
    return out


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The rank of the substring that starts at each left-most-S position, equal ones alike."""
    ends = np.empty(len(text), np.int64)
    ends[lms] = np.concatenate((lms[1:] + 1, [len(text)]))
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    same = (ends[a] - a == ends[b] - b) & (ends[a] != len(text)) & (ends[b] != len(text))
    step, open_ = 0, np.flatnonzero(same)
    while len(open_):
        differ = text[a[open_] + step] != text[b[open_] + step]
        same[open_[differ]] = False
        step += 1
        open_ = open_[~differ]
        open_ = open_[step < ends[a[open_]] - a[open_]]
    rank = np.concatenate(([0], np.cumsum(~same)))
    names = np.empty(len(text), np.int64)
    names[ordered] = rank
    return names[lms]


def _rank_suffixes(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` symbols, by doubling."""
    rank, step = names.astype(np.int64), 1
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    while step < depth:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank, step = new, step * 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


def _on_disk(array: np.ndarray, most: int) -> np.ndarray:
    """The array, or a map of a temporary file without a name where it is larger than ``most`` bytes."""
    if array.nbytes <= most:
        return array
    file = tempfile.TemporaryFile()
    array.tofile(file)
    return np.memmap(file, array.dtype, "r+", shape=array.shape)


def suffix_array(text: np.ndarray, depth: int, symbols: int = 257, memory: int = 1 << 20, recursive: bool = False, whole: int = 64 << 20) -> np.ndarray:
    """Start positions in the order of the suffixes' first ``depth`` symbols at least; queues hold ``memory``
    bytes, and texts and types above ``whole`` bytes are mapped files."""
    text = _on_disk(np.ascontiguousarray(text, np.int16 if symbols <= 1 << 15 else np.int32), whole)
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    stype = _on_disk(s_types(text), whole)
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]).astype(np.int32) + 1
    larger, smaller = induce(text, stype, _by_symbol(text, lms, symbols), symbols, memory)
    if len(lms) > 1:
        first = np.zeros(len(text), bool)
        first[lms] = True
        sorted_s = np.concatenate(smaller)
        names = _names(text, lms, sorted_s[first[sorted_s]])
        kinds = int(names.max()) + 1
        if recursive and kinds < len(names):
            order = suffix_array(names, len(names), kinds, memory, True, whole)
        else:
            order = _rank_suffixes(names, depth // 2 + 1)  # a substring covers two symbols at least
        larger, smaller = induce(text, stype, _by_symbol(text, lms[order], symbols), symbols, memory)
    return np.concatenate([part for c in range(symbols) for part in (larger[c], smaller[c])])


def equal_starts(text: np.ndarray, array: np.ndarray, length: int) -> np.ndarray:
    """For consecutive entries of ``array`` whether their first ``length`` symbols are the same."""
    a, b = array[:-1].astype(np.int64), array[1:].astype(np.int64)
    same, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for lo, hi in ((0, 4), (4, 16), (16, length)):
        reach, left = np.arange(min(lo, length), min(hi, length)), []
        for part in np.array_split(open_, len(open_) // 16_384 + 1):
            left.append(part[(text[a[part][:, None] + reach] == text[b[part][:, None] + reach]).all(axis=1)])
        open_ = np.concatenate(left)
    same[open_] = True
    return same
