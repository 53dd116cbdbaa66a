"""Words of many texts at once, as arrays: boundaries, 64-bit hashes and ragged gathers."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

from sievespark.llm.common import mix64

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
SPACE = np.zeros(256, bool)
SPACE[0x20] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


class Words:
    """Runs of bytes between separators in a list of texts.

    ``starts``, ``ends``: byte ranges in ``data``; ``doc``: index of the text;
    ``first[i]:first[i + 1]``: the words of text i.
    """

    def __init__(self, texts: list[bytes | None], white: np.ndarray = _WHITE, lower: bool = False) -> None:
        texts = [t or b"" for t in texts]
        joined = b" ".join(texts) + b" " * 9
        self.data = joined.lower() if lower else joined
        self.bytes = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes + 1) - 1
        self.text_starts = self.text_ends - sizes
        gap = white[self.bytes]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, np.concatenate((self.text_starts, [len(self.data)])))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return range_hashes(self.bytes, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; eight bytes past the last must be readable."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lanes = as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    sizes = ends - starts
    out = mix64((lanes[starts] & _MASKS[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at = 8
    own = np.flatnonzero(sizes > at)
    while len(own):
        more = lanes[starts[own] + at] & _MASKS[np.minimum(sizes[own] - at, 8)]
        out[own] = mix64(out[own] * np.uint64(0x9FB21C651E98DF25) + more)
        at += 8
        own = own[sizes[own] > at]
    return out


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges ``values[starts[i] : starts[i] + sizes[i]]``, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i] : first[i + 1]]``, 0 where empty."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within each text, a shorter text's whole sequence as one; and the bounds of each text's runs."""
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    if not bounds[-1]:
        return np.empty(0, np.uint64), bounds
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    at = np.repeat(first[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    width = np.repeat(np.minimum(counts, size), runs)
    total = np.zeros(bounds[-1], np.uint64)
    for k in range(size):
        part = total * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]
        total = np.where(k < width, part ^ (part >> np.uint64(29)), total) if (width <= k).any() else part ^ (part >> np.uint64(29))
    return mix64(total + width.astype(np.uint64)), bounds


class Ragged:
    """Byte strings by 64-bit key in flat arrays, for entries that vectorised gathers read."""

    def __init__(self, fields: int) -> None:
        self.fields = fields
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat = [np.empty(1 << 16, np.uint8) for _ in range(self.fields)]
        self.ends = [np.zeros(1 << 12, np.int64) for _ in range(self.fields)]

    def add(self, keys: list[int], values: list[list[bytes]]) -> None:
        n = len(self.rows)
        self.rows.update(zip(keys, range(n, n + len(keys)), strict=True))
        for f in range(self.fields):
            data = np.frombuffer(b"".join(values[f]), np.uint8)
            sizes = np.fromiter(map(len, values[f]), np.int64, len(keys))
            if n + len(keys) + 1 > len(self.ends[f]):
                self.ends[f] = np.concatenate((self.ends[f], np.zeros(n + 2 * len(keys) + 1, np.int64)))
            used = int(self.ends[f][n])
            if used + len(data) > len(self.flat[f]):
                self.flat[f] = np.concatenate((self.flat[f], np.empty(used + 2 * len(data), np.uint8)))
            self.flat[f][used : used + len(data)] = data
            self.ends[f][n + 1 : n + 1 + len(keys)] = used + np.cumsum(sizes)

    def gather(self, field: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of ``rows`` in a row, and their sizes."""
        starts = self.ends[field][rows]
        sizes = self.ends[field][rows + 1] - starts
        return spread(self.flat[field], starts, sizes), sizes
