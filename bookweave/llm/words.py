"""Words of Arrow text columns as 64-bit hashes, computed over whole buffers.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z.  All of it works on the UTF-8 bytes of a column, a
bounded number of bytes at a time, so a batch with long texts takes no more memory than one with short ones
(but for a single text, which is held whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C55)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits: for words without punctuation.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes taken at a time.
CHUNK = 2 << 20
SEGMENT = 1 << 18

_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers well spread."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _power(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * SEGMENT)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (BASE, inverse)]
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``most`` bytes."""
    data, offsets = buffers(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(rows, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and for each text the range of its words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = ~space[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = full[inner]
    last[inner - 1] = full[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word."""
    out = np.empty(len(starts), U)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(starts // SEGMENT)) + 1, [len(starts)]]) if len(starts) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        low, high = starts[a], ends[b - 1]
        part = data[low:high]
        part = (LOWER[part] if lower else part).astype(U) + U(1)
        power, inverse = _power(len(part) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(part * power[: len(part)], dtype=U)])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U))
    return out


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words of each text, and their ranges.  A text of fewer words has its
    whole sequence as its only one, a text without words none.  ``at``: ranges of the texts' words."""
    count = np.diff(at)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    ranges = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(ranges[-1], U)
    factor = mixed(np.arange(1, n + 1, dtype=U) * BASE) | U(1)
    if len(words) >= n:
        every = np.zeros(len(words) - n + 1, U)
        for k in range(n):
            every += words[k : len(words) - n + 1 + k] * factor[k]
        starts = np.arange(len(every))
        row = np.repeat(np.arange(len(count)), count)[: len(every)]
        good = starts + n <= at[row + 1]
        long_row = np.repeat(count >= n, made)
        out[long_row] = mixed(every[good])
    for d in np.flatnonzero((count > 0) & (count < n)):
        own = words[at[d] : at[d + 1]]
        out[ranges[d]] = mixed((own * factor[: len(own)]).sum(dtype=U, keepdims=True) + U(len(own)))[0]
    return out, ranges


class Index:
    """Positions of distinct 64-bit hashes, found for whole arrays: the top bits choose a bucket, in which
    the few sorted hashes are tried one after another."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order.astype(np.int32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = U(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """For each wanted hash its position among the keys as they were given, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        top = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        at, end, goal = at[left], end[left], wanted[left]
        while len(left):
            key = self.keys[at]
            hit = key == goal
            out[left[hit]] = self.order[at[hit]]
            more = (key < goal) & (at + 1 < end)
            left, at, end, goal = left[more], at[more] + 1, end[more], goal[more]
        return out


class Counter:
    """Counts of 64-bit hashes, merged in bounded memory: ``add`` returns what must be passed on."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])
        if self.size < 4 * self.most:
            return None
        merged = self._merge()
        if len(merged[0]) >= self.most:
            return merged
        self.parts, self.size = [merged], len(merged[0])
        return None

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        self.parts, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def rest(self) -> tuple[np.ndarray, np.ndarray] | None:
        return self._merge() if self.parts else None
