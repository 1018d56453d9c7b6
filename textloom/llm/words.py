"""Words of many texts at once, and 64-bit hashes of words and word sequences, in numpy.

A word is a maximal run of bytes other than space and TAB to CR. Its hash is a
polynomial over a random table of byte values modulo 2**64, taken from one prefix
sum over the buffer, then mixed. Such polynomials are equal for some long strings of
two letters (Thue-Morse), whatever the table, so words over ``PART`` bytes are hashed
in parts, which are mixed with their places. Windows are hashed like short words over
word hashes, whole sequences by mixed places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import raw

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BASE = int(_rng.integers(1, 2**62)) * 4 + 1
_SEQ = int(_rng.integers(1, 2**62)) * 4 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 20
#: Bytes of a word that one polynomial takes.
PART = 64
_STEP = _U(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of one block are kept, more are made for the single long text that needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, _BLOCK + 2), base, np.uint64)
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        _powers[base] = have[: _BLOCK + 2].copy() if n > _BLOCK + 2 else have
    return have[:n]


_BASE_INV, _SEQ_INV = pow(_BASE, -1, 2**64), pow(_SEQ, -1, 2**64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _placed(hashes: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Hashes mixed with their places, to be summed."""
    return mix(hashes + place.astype(np.uint64) * _STEP, salt)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of each data[start:end]; spans are ordered and disjoint."""
    size = ends - starts
    long = size > PART
    if not long.any():
        return _part_hashes(data, starts, ends, values)
    parts = np.maximum(-(-size // PART), 1)
    first = np.cumsum(parts) - parts
    place = np.arange(parts.sum()) - np.repeat(first, parts)
    lo = np.repeat(starts, parts) + place * PART
    own = _part_hashes(data, lo, np.minimum(lo + PART, np.repeat(ends, parts)), values)
    total = np.add.reduceat(_placed(own, place, 3), first)
    return np.where(long, mix(total + size.astype(np.uint64), 4), own[first])


def _part_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Polynomial hash of each data[start:end]. Works in blocks, so memory is bounded by the longest span."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = ends[j - 1]
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data[lo:hi]] * powers(_BASE, hi - lo), out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * powers(_BASE_INV, hi - lo + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


class Words:
    """Words of every row of a string array: ``start``/``end`` byte positions, ``hash``, and rows ``lo[r]:hi[r]`` of them."""

    def __init__(self, array: pa.Array, lower: bool = False, hashes: bool = True):
        self.data, self.offsets = data, offs = raw(array)
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.lo = np.searchsorted(self.start, offs[:-1])
        self.hi = np.searchsorted(self.start, offs[1:])
        self.count = self.hi - self.lo
        if hashes:
            self.hash = span_hashes(data, self.start, self.end, _LOWER if lower else _BYTES)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of ``size`` words from each word on, over the whole array, and whether they lie in one row."""
        n = len(self.start)
        fits = np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        if n >= size:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hash * powers(_SEQ, n), out=total[1:])
            out[: n - size + 1] = mix((total[size:] - total[:-size]) * powers(_SEQ_INV, n)[: n - size + 1], size)
            last = np.repeat(self.hi, self.count)
            fits = np.arange(n) + size <= last
        return out, fits

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each row's whole word sequence, its length among what is hashed."""
        n = len(self.start)
        place = np.arange(n) - np.repeat(self.lo, self.count)
        out = []
        for salt in (0, 1):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_placed(self.hash, place, 5 + salt), out=total[1:])
            out.append(mix(total[self.hi] - total[self.lo] + self.count.astype(np.uint64), salt))
        return out[0], out[1]
