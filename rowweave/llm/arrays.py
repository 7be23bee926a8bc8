"""Numpy kernels over Arrow text columns: blocks of whole texts, hashed words, shingles, hash tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that a kernel takes at once; a longer text is a block of its own.
BLOCK = 1 << 19
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
#: What tokens consist of: anything but white space.
IN_TOKEN = np.ones(256, bool)
IN_TOKEN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) for runs of rows of at most limit bytes of UTF-8, or one row; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the power 0 to n at least."""
    if len(_powers[base]) <= n:
        factors = np.full(max(n + 1, BLOCK + 1), base, U64)
        factors[0] = 1
        found = np.multiply.accumulate(factors)
        if n > BLOCK:
            return found
        _powers[base] = found
    return _powers[base]


def word_hashes(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of 0-9, a-z, beyond ASCII; of such bytes), and the offsets of each text's words."""
    n = len(data)
    if not n:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    inside = of[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * _power(_BASE, n)[:n], out=sums[1:])
    hashes = (sums[end] - sums[first]) * _power(_INVERSE, n)[first]
    return mixed(hashes + (end - first).astype(U64)), np.searchsorted(first, offsets)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text and their offsets; a text of fewer words, but not none, has one run."""
    n = len(words)
    sizes = np.diff(at)
    rolled = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        rolled += words[j : n - k + 1 + j] * U64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    rolled = mixed(rolled)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out_at = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_at[-1], U64)
    whole = np.flatnonzero(sizes >= k)
    into = _ranges(out_at[whole], counts[whole])
    out[into] = rolled[_ranges(at[whole], counts[whole])]
    for i in np.flatnonzero((sizes < k) & (sizes > 0)):
        with np.errstate(over="ignore"):
            h = U64(sizes[i])
            for w in words[at[i] : at[i + 1]]:
                h = mixed(np.array([h * U64(31) + w]))[0]
        out[out_at[i]] = h
    return out, out_at


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class Lookup:
    """An open-addressing hash table from 64-bit keys (not all ones) to their place in the array of keys."""

    EMPTY = U64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(U64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.place = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            placed = self.place[slot] == left
            self.keys[slot[placed]] = keys[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.place[slot], -1)
        left = np.flatnonzero((there != keys) & (there != self.EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.place[slot[hit]]
            on = ~hit & (there != self.EMPTY)
            left, slot = left[on], slot[on]
        return out


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of values[at[i] : at[i + 1]] for each i."""
    out = np.zeros(len(at) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, at[full])
    return out
