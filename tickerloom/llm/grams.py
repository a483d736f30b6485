"""Word n-grams of many texts at once, hashed with numpy.

The words of a batch are written into one byte stream with a single blank before each. A
run of consecutive words is then a byte range of that stream, and a polynomial prefix sum
gives the 64-bit hash of any range in constant time, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = 0x20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word when white space separates, and when all ASCII but letters and digits does.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = True
ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True

#: Powers are kept for streams of usual length; a very long text has its own.
KEPT_POWERS = 3 << 19

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(way: str, n: int) -> np.ndarray:
    held = _powers[way]
    if len(held) < n:
        size = max(n, 1 << 16)
        step = np.full(size, BASE if way == "up" else INVERSE, np.uint64)
        step[0] = 1
        held = np.cumprod(step, dtype=np.uint64)
        if size <= KEPT_POWERS:
            _powers[way] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch: ``stream[start[i]:end[i]]`` is word i, ``doc[i]`` its text."""

    stream: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each text's first word, one more entry at the end
    prefix: np.ndarray

    def runs(self, n: int) -> np.ndarray:
        """Indexes of the words that begin a run of n words of one text."""
        last = len(self.doc) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])

    def hashes(self, begin: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs of n words that begin at the words ``begin``."""
        s, e = self.start[begin], self.end[begin + n - 1]
        down = _power("down", len(self.stream) + 1)
        return mix((self.prefix[e] - self.prefix[s]) * down[s])

    def bytes_of(self, begin: int, n: int) -> bytes:
        return self.stream[self.start[begin] : self.end[begin + n - 1]].tobytes()


def words(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Words:
    """Words of texts given as bytes; ``letters`` marks the bytes of words after lower-casing."""
    low = _LOWER[raw]
    inside = letters[low]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(raw)]
    before[bounds] = False
    begins = inside & ~before
    starts = np.flatnonzero(begins)
    n = len(starts)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    kept = np.cumsum(inside)  # word bytes up to and with each byte
    total = int(kept[-1]) if len(kept) else 0
    # word i begins after the bytes of the words before it and i + 1 blanks
    start = (kept[starts] - 1 + np.arange(1, n + 1)) if n else np.zeros(0, np.int64)
    end = np.empty(n, np.int64)
    if n:
        end[:-1] = start[1:] - 1
        end[-1] = total + n
    stream = np.full(total + n, BLANK, np.uint8)
    if n:
        spot = np.ones(total + n, bool)
        spot[start - 1] = False
        stream[spot] = low[inside]
    prefix = np.zeros(len(stream) + 1, np.uint64)
    np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * _power("up", len(stream)), out=prefix[1:])
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(stream, start, end, doc, first, prefix)
