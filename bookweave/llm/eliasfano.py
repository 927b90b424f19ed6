"""Monotone sequences in Elias-Fano form, and an n-gram trie made of them, for whole arrays of queries."""

from __future__ import annotations

import mmap
from functools import cached_property

import numpy as np

U = np.uint64


def _bits(x: np.ndarray) -> np.ndarray:
    """The bits of words, the lowest first, and of what follows them up to a whole word none."""
    return np.packbits(np.append(x, np.zeros(-len(x) % 64 + 64, x.dtype)), bitorder="little").view(U)


class Monotone:
    """x[0] <= x[1] <= ...: low bits packed, high parts in unary.  Places of ones and of zeros in the unary bits are
    listed when they are first asked for."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, x: np.ndarray) -> Monotone:
        n, top = len(x), int(x[-1]) + 1 if len(x) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.empty((n, bits), np.uint8)
        for b in range(bits):
            low[:, b] = (x >> b) & 1
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        high[(x.astype(np.int64) >> bits) + np.arange(n)] = 1
        return cls(n, bits, _bits(low.ravel()), _bits(high))

    def low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        value |= (self.low[word + 1] << U(1)) << (U(63) - shift)
        return (value & U((1 << self.low_bits) - 1)).astype(np.int64)

    @cached_property
    def _ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")).astype(np.int32)

    @cached_property
    def _begins(self) -> np.ndarray:
        """Index of the first value of each high part: behind the zero before it."""
        zeros = np.flatnonzero(np.unpackbits(~self.high.view(np.uint8), bitorder="little"))
        return np.append(0, zeros - np.arange(len(zeros))).astype(np.int32)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._ones[i] - i).astype(np.int64) << self.low_bits | self.low_part(i)

    def every(self) -> np.ndarray:
        return self.access(np.arange(self.n))

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value (distinct values), or -1: its successor, if that is equal to it."""
        out = np.full(len(value), -1, np.int64)
        if not self.n:
            return out
        high = value >> self.low_bits
        left = np.flatnonzero(high < len(self._begins) - 1)
        goal = value[left] & ((1 << self.low_bits) - 1)
        low, end = (self._begins[high[left] + k].astype(np.int64) for k in (0, 1))
        up = end.copy()
        open_ = np.flatnonzero(low < up)
        # Halving within the values of one high part: a context of many words lies in few of them.
        while len(open_):
            middle = (low[open_] + up[open_]) >> 1
            less = self.low_part(middle) < goal[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            up[open_] = np.where(less, up[open_], middle)
            open_ = open_[low[open_] < up[open_]]
        at = np.flatnonzero(low < end)
        at = at[self.low_part(low[at]) == goal[at]]
        out[left[at]] = low[at]
        return out


#: A code is a log10 in steps of one over this, below 0; a byte reaches to -15.9.
STEPS = 16


def codes_of(log: np.ndarray) -> np.ndarray:
    """Codes of one byte of log10 probabilities and weights."""
    return np.clip(np.rint(-log * STEPS), 0, 255).astype(np.uint8)


class Trie:
    """Levels of n-grams of 1 to 3 words.  A level holds, in the order of its contexts, the words relative to
    their context (each context's range begins above the end of the one before), the ranges, and quantised
    log10 probabilities and back-off weights.  All arrays lie in one buffer."""

    def __init__(self, arrays: dict[str, np.ndarray], meta: dict):
        self.a, self.meta = arrays, meta
        self.ranges = {k: self._sequence(f"range{k}") for k in (2, 3)}
        self.words = {k: self._sequence(f"word{k}") for k in (2, 3)}
        self.bounds = {k: self._bounds(k) for k in (2, 3)}

    def _sequence(self, name: str) -> Monotone:
        n, bits = self.meta[name]
        return Monotone(n, bits, self.a[name + ".low"], self.a[name + ".high"])

    def _bounds(self, k: int) -> np.ndarray:
        """Where the numbers of each context's words begin in level ``k``, and where the last ones end."""
        at = self.ranges[k].every()
        bounds = np.zeros(len(at), np.int64)
        later = np.flatnonzero(at > 0)
        bounds[later] = self.words[k].access(at[later] - 1) + 1
        return bounds

    @classmethod
    def build(cls, levels: dict[int, dict[str, np.ndarray]], contexts: dict[int, int]) -> Trie:
        """``levels[k]``: log10 ``prob`` and back-off ``gamma``; for k > 1 also ``context`` (index in the level
        below, in order) and ``word`` (in order within a context).  ``contexts[k]``: size of the level below."""
        arrays, meta = {}, {}
        for k, level in levels.items():
            for part in ("prob", "gamma"):
                if part in level:
                    arrays[f"{part}{k}"] = codes_of(level[part])
            if k == 1:
                continue
            at = np.searchsorted(level["context"], np.arange(contexts[k] + 1))
            end = np.concatenate([[0], level["word"] + 1])[at[1:]] * (at[1:] > at[:-1])
            base = np.concatenate([[0], np.cumsum(end)])
            for name, x in ((f"range{k}", at), (f"word{k}", level["word"] + base[level["context"]])):
                m = Monotone.of(x)
                meta[name] = (m.n, m.low_bits)
                arrays |= {name + ".low": m.low, name + ".high": m.high}
        return cls(arrays, meta)

    def pack(self) -> tuple[bytes, dict]:
        """One buffer and where each array lies in it."""
        parts, where, at = [], {}, 0
        for name, x in self.a.items():
            raw = x.tobytes()
            where[name] = (at, len(x), x.dtype.str)
            parts.append(raw + bytes(-len(raw) % 8))
            at += len(parts[-1])
        return b"".join(parts), {"where": where, "meta": self.meta}

    @classmethod
    def mapped(cls, data: bytes, layout: dict) -> Trie:
        """The levels in a mapping of memory without a file."""
        memory = mmap.mmap(-1, max(1, len(data)))
        memory.write(data)
        return cls({k: np.frombuffer(memory, t, n, at) for k, (at, n, t) in layout["where"].items()}, layout["meta"])

    def child(self, k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index in level ``k`` of each word after its context (an index in the level below), or -1."""
        begin, end = self.bounds[k][context], self.bounds[k][context + 1]
        goal = begin + word
        out = np.full(len(context), -1, np.int64)
        some = np.flatnonzero(goal < end)
        out[some] = self.words[k].find(goal[some])
        return out

    def prob(self, k: int, i: np.ndarray) -> np.ndarray:
        return -self.a[f"prob{k}"][i].astype(float) / STEPS

    def gamma(self, k: int, i: np.ndarray) -> np.ndarray:
        return -self.a[f"gamma{k}"][i].astype(float) / STEPS
