"""Induced suffix sorting in memory.

Suffixes are left-to-right minima (LMS) or are induced: once the suffixes that start with a symbol are in order, the suffixes one position before
them follow in that order within their own symbol. The queue that carries them is a priority queue whose priorities are
symbols: pops come with a symbol's suffixes in order of arrival, and each pop pushes to symbols not yet passed. Pushes and pops are whole
arrays. What waits in a queue beyond `room` suffixes goes to a scratch file, but that bounds the queue alone: the text, its types, the names of LMS
substrings and the sorted suffixes are held in memory, so this is no external sort.

Only order up to `depth` symbols matters to the callers here. The recursion sorts the names of the LMS substrings; as they form a large alphabet, it is
done by doubling, which ends as soon as names are distinct or reach depth. Common prefixes of neighbours are then measured 8 bytes at a time, up to depth.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from tessera.llm.anchors import spans_hash


class BucketQueue:
    """Arrays of positions by symbol, popped in order of arrival; the rest goes to disk beyond room positions."""

    def __init__(self, n_symbols: int, room: int):
        self.held: list[list] = [[] for _ in range(n_symbols)]
        self.room, self.size, self.file = room, 0, None

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Deal positions out by symbol, each symbol's in the order given."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for s, part in zip(symbols[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts)):
            self.held[s].append(part)
        self.size += len(positions)
        if self.size > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, os.SEEK_END)
        for parts in self.held:
            for i, p in enumerate(parts):
                if isinstance(p, np.ndarray):
                    parts[i] = (self.file.tell(), len(p), p.dtype)
                    self.file.write(np.ascontiguousarray(p).tobytes())
        self.size = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """All that has arrived for a symbol since the last pop."""
        parts, self.held[symbol] = self.held[symbol], []
        if not parts:
            return None
        for i, p in enumerate(parts):
            if isinstance(p, tuple):
                self.file.seek(p[0])
                parts[i] = np.frombuffer(self.file.read(p[1] * p[2].itemsize), dtype=p[2])
            else:
                self.size -= len(p)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as less than any symbol."""
    n = len(text)
    sign = np.empty(n, dtype=np.int8)
    sign[:-1] = (text[:-1] < text[1:]).view(np.int8) - (text[:-1] > text[1:]).view(np.int8)
    sign[-1] = -1
    decides = np.where(sign != 0, np.arange(n, dtype=np.int64), n)
    return sign[np.minimum.accumulate(decides[::-1])[::-1]] == 1


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, n_symbols: int, room: int) -> tuple[list, list]:
    """From LMS positions in order: by symbol, the larger-type suffixes in order and the smaller-type in reverse order."""
    none = seeds[:0]
    cuts = np.searchsorted(text[seeds], np.arange(n_symbols + 1))
    queue = BucketQueue(n_symbols, room)
    larger, small = [], []

    def before(positions: np.ndarray, want: bool) -> None:
        p = positions - 1
        p = p[p >= 0]
        p = p[smaller[p] == want]
        queue.push(text[p], p)

    last = np.array([len(text) - 1], dtype=seeds.dtype)
    queue.push(text[last], last)
    for c in range(n_symbols):
        parts = []
        while (found := queue.pop(c)) is not None:
            parts.append(found)
            before(found, False)
        larger.append(np.concatenate(parts) if parts else none)
        before(seeds[cuts[c] : cuts[c + 1]], False)
    for c in reversed(range(n_symbols)):
        parts = []
        while (found := queue.pop(c)) is not None:
            parts.append(found)
            before(found, True)
        small.append(np.concatenate(parts) if parts else none)
        before(larger[c][::-1], True)
    return larger, small[::-1]


def sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of names, by doubling, until all are distinct or depth names have been compared."""
    rank = names.astype(np.int64)
    done = 1
    while done < depth:
        key = rank * (int(rank.max()) + 2)
        key[:-done] += rank[done:] + 1
        _, rank = np.unique(key, return_inverse=True)
        if int(rank.max()) == len(rank) - 1:
            break
        done *= 2
        if done >= len(rank):
            break
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, n_symbols: int, depth: int, room: int = 1 << 24) -> np.ndarray:
    """Positions of text (symbols below n_symbols) in the order of their suffixes, exact for the first depth symbols."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = smaller_types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32 if n < 1 << 31 else np.int64) + 1
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    larger, small = induce(text, smaller, by_symbol, n_symbols, room)
    if len(lms) > 1:
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        found = np.concatenate([s[::-1] for s in small])
        found = found[is_lms[found]]  # LMS substrings in order
        ends = np.empty(n, dtype=np.int64)
        ends[lms] = np.append(lms[1:] + 1, n)
        content = spans_hash(text.astype(np.uint64) + np.uint64(1), found, ends[found])
        new = np.concatenate(([True], (content[1:] != content[:-1]) | (found[1:] == lms[-1]) | (found[:-1] == lms[-1])))
        name = np.empty(n, dtype=np.int64)
        name[found] = np.cumsum(new) - 1
        larger, small = induce(text, smaller, lms[sort_names(name[lms], depth)], n_symbols, room)
    return np.concatenate([x for c in range(n_symbols) for x in (larger[c], small[c][::-1])])


def prefix_at_least(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], for pairs of positions, byte by byte in words of 8."""
    same = np.ones(len(a), dtype=bool)
    if size < 8:
        for i in range(size):
            same &= data[a + i] == data[b + i]
        return same
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    left = np.arange(len(a))
    for at in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        ok = eight[a[left] + at] == eight[b[left] + at]
        if not ok.all():
            same[left[~ok]] = False
            left = left[ok]
    return same
