"""Words, word hashes and n-gram hashes of whole Arrow string columns, in numpy.

A word is a run of bytes other than the six ASCII blanks (space, tab, line feed,
vertical tab, form feed, carriage return), which is ``[^\\x20\\x09-\\x0D]+`` on
UTF-8 text.  Every function works on a slice of some half a megabyte of text, so
memory does not depend on the batch, and no Python loop runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Blanks for words made of letters, digits and bytes beyond ASCII only.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base², … modulo 2^64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def release() -> None:
    """Give freed memory back to the system; a reused Python worker would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@dataclass
class Slice:
    """Some consecutive texts: rows ``lo`` to ``hi`` of the batch."""
    lo: int
    hi: int
    data: np.ndarray        # their bytes
    offsets: np.ndarray     # where each text begins in data, and the end
    starts: np.ndarray      # of each word, in data
    ends: np.ndarray
    bounds: np.ndarray      # text i has the words bounds[i] to bounds[i + 1]

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word (its bytes; A-Z as a-z if ``lower``)."""
        n = len(self.data)
        digits = _BYTE[(_LOWER if lower else _SAME)[self.data]] * _power(_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(digits, out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * _power(_INVERSE, n + 1)[self.starts])

    def words_of(self, i: int, lower: bool = False) -> list[bytes]:
        """The words of the i-th text of the slice."""
        raw = self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()
        return (raw.lower() if lower else raw).split()

    def text_of_word(self) -> np.ndarray:
        """For each word, the number of its text in the slice."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(column: pa.Array, size: int = SLICE_BYTES, blank: np.ndarray = _BLANK) -> Iterator[Slice]:
    """The texts of a column (null: empty) in slices of about ``size`` bytes; a longer text is one slice.

    Memory freed meanwhile goes back to the system at the end.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, raw = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    everything = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        data = everything[offsets[lo]:offsets[hi]]
        inside = offsets[lo:hi + 1] - offsets[lo]
        ink = ~blank[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[inside] = True
        first, last = ink.copy(), ink.copy()
        if len(data):
            first[1:] &= ~ink[:-1] | edge[1:-1]
            last[:-1] &= ~ink[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        yield Slice(lo, hi, data, inside, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, inside))
        lo = hi
    release()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words (across texts too; see ``inside``)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out *= np.uint64(_BASE)
        out += hashes[i:i + count]
    return mix(out)


def inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``total - n + 1`` windows of n words lie within one text."""
    count = max(total - n + 1, 0)
    ok = np.ones(count, bool)
    for back in range(1, n):
        at = bounds[1:-1] - back
        ok[at[(at >= 0) & (at < count)]] = False
    return ok
