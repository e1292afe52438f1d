"""Vectorised words of UTF-8 texts: boundaries and 64-bit hashes in numpy, without a Python object per word."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of [^\x20\x09-\x0D]+ end at these bytes.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and every byte of a non-ASCII character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Entries of a table of powers.
BITS = 16
BLOCK = 1 << BITS
#: Bytes whose prefix array is held at once where spans of many bytes are hashed.
STRETCH = 1 << 20
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes() -> np.ndarray:
    if "codes" not in _TABLES:
        _TABLES["codes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _TABLES["codes"]


def _powers() -> tuple[np.ndarray, ...]:
    """factor**i, factor**-i, and both for multiples of BLOCK: tables of a fixed size whose products give any power of a place below BLOCK**2."""
    if "up" not in _TABLES:
        inverse = pow(int(_FACTOR), -1, 1 << 64)
        bases = {"up": int(_FACTOR), "down": inverse, "far_up": pow(int(_FACTOR), BLOCK, 1 << 64), "far_down": pow(inverse, BLOCK, 1 << 64)}
        for name, base in bases.items():
            steps = np.full(BLOCK, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return tuple(_TABLES[x] for x in ("up", "down", "far_up", "far_down"))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of data[i:j], scaled by factor**i; modulo 2**64. Made in blocks, so that little but the result is held."""
    up, _, far, _ = _powers()
    codes = _byte_codes()
    out = np.zeros(len(data) + 1, np.uint64)
    for k, i in enumerate(range(0, len(data), BLOCK)):
        terms = codes[data[i : i + BLOCK]]
        terms *= up[: len(terms)]
        terms *= far[k]
        terms[:1] += out[i : i + 1]
        np.cumsum(terms, out=out[i + 1 : i + 1 + len(terms)])
    return out


def whole_hash(data: np.ndarray) -> np.ndarray:
    """What span_hash gives for all of data, in one entry and without its prefix array."""
    up, _, far, _ = _powers()
    codes, total = _byte_codes(), np.zeros(1, np.uint64)
    for k, i in enumerate(range(0, len(data), BLOCK)):
        terms = codes[data[i : i + BLOCK]]
        terms *= up[: len(terms)]
        total += terms.sum(dtype=np.uint64, keepdims=True) * far[k]
    return mix(total + np.uint64(len(data)))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: equal for equal bytes, wherever they stand."""
    _, down, _, far = _powers()
    back = down[start & (BLOCK - 1)]
    if len(prefix) > BLOCK:
        back *= far[start >> BITS]
    return mix((prefix[end] - prefix[start]) * back + (end - start).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash of ascending spans that don't overlap, with prefix arrays of STRETCH bytes at most, whatever the length of data."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + STRETCH, side="right")))
        if ends[i] - base > STRETCH:
            out[i:j] = whole_hash(data[base : ends[i]])
        else:
            out[i:j] = span_hash(prefix_hash(data[base : ends[j - 1]]), starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the number of words before each text (len(offsets) entries). Words don't cross texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~breaks[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the number of words before each text."""
    low = lowered(data)
    starts, ends, first = bounds(low, offsets, breaks)
    return span_hashes(low, starts, ends), first


class HashTable:
    """A fixed-size two-way table from 64-bit hashes to integers, looked up and filled by whole arrays.

    A full slot is overwritten, so memory is bounded and an evicted key is simply a miss later.
    """

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros((2, 1 << bits), np.uint64)
        self.values = np.zeros((2, 1 << bits), np.int32)

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes & self.mask).astype(np.int64), ((hashes >> np.uint64(32)) & self.mask).astype(np.int64)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Values of hashes, -1 where there is none."""
        one, two = self._slots(hashes)
        out = np.where(self.keys[0][one] == hashes, self.values[0][one], -1)
        rest = np.flatnonzero(out < 0)
        at = two[rest]
        out[rest] = np.where(self.keys[1][at] == hashes[rest], self.values[1][at], -1)
        return out

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct."""
        one, two = self._slots(hashes)
        free = self.keys[0][one] == 0
        self.keys[0][one[free]] = hashes[free]
        self.values[0][one[free]] = values[free]
        lost = self.keys[0][one] != hashes
        self.keys[1][two[lost]] = hashes[lost]
        self.values[1][two[lost]] = values[lost]
