"""Words, lines and their hashes for whole Arrow batches of texts.

The functions work on the UTF-8 bytes of a batch at once. The word separators
(``[\\x20\\x09-\\x0D]``) are ASCII, so words of bytes are words of code points.
A word's 64-bit hash is multilinear: each byte's random value times the random
coefficient of its place in the word, summed and mixed. No structure of two words
makes them meet, as it does under powers of one base. A-Z and a-z share their
values when ``fold`` is set.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19           # texts are handled about so many bytes at a time
ODD = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=2)
def _byte_values(fold: bool) -> np.ndarray:
    v = mix((np.arange(256, dtype=np.uint64) + U(1)) * ODD) | U(1)
    if fold:
        v[65:91] = v[97:123]
    v[32] = 0
    v[9:14] = 0
    return v


_places: list[np.ndarray] = [np.zeros(0, np.uint64)]


def coefficients(n: int) -> np.ndarray:
    """The odd random coefficients of n places or more."""
    if len(_places[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        _places[0] = mix(np.arange(1, size + 1, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)
    return _places[0]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of ``values`` from a start to its end; starts rise, and runs don't overlap."""
    if not len(starts):
        return np.zeros(0, U)
    first, last = int(starts[0]), int(ends[-1])
    reach = np.diff(np.append(starts, last))            # up to the next run
    kind = np.int32 if last - first < 1 << 31 else np.int64
    place = np.arange(last - first, dtype=kind) - np.repeat((starts - first).astype(kind), reach)
    v = values[first:last] * coefficients(int(reach.max()))[place]
    length = ends - starts
    if (reach != length).any():                         # what lies between two runs does not count
        v[place >= np.repeat(length.astype(kind), reach)] = 0
    return mix(np.add.reduceat(v, starts - first) + length.astype(U) * ODD)


_SPACE = re.compile(rb"[ \t-\r]")
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[32] = True
SEPARATOR[9:14] = True


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, count=n + 1, offset=8 * col.offset)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, count=hi - lo, offset=lo) if hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


#: Rows of a batch that a tidy task handles at a time.
TIDY_ROWS = 1024


def tidy(run):
    """A task's function that sees its batches in small slices, and gives freed memory back at its end: the worker
    goes on to other stages."""
    def tidied(batches):
        try:
            yield from run(b.slice(i, TIDY_ROWS) for b in batches for i in range(0, b.num_rows, TIDY_ROWS))
        finally:
            release_memory()
    return tidied


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # another C library
        pass


def word_pieces(raw: bytes, size: int = 2 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about ``size`` bytes each."""
    start = 0
    while start < len(raw):
        end = start + size
        if end < len(raw):                      # to the end of the word that ``size`` bytes cut
            space = _SPACE.search(raw, end)
            end = space.start() if space else len(raw)
        yield raw[start:end].split()
        start = end


class Words:
    """The words of the texts ``first`` to ``first + len(self.counts)`` of a batch."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, first: int, fold: bool):
        self.raw, self.offsets, self.first = raw, offsets, first
        solid = ~SEPARATOR[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(raw) + 1, dtype=bool)
        before[0] = False
        before[1:] = solid
        now = np.append(solid, False)
        self.starts = np.flatnonzero(now & (~before | edge))
        self.ends = np.flatnonzero(before & (~now | edge))
        self.solid = solid
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.hashes = run_hashes(_byte_values(fold)[raw], self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and each text's bounds among them.

        Runs over the end of a text are left out."""
        w = self.hashes
        n = max(0, len(w) - size + 1)
        acc = np.zeros(n, np.uint64)
        for k in range(size):
            acc = mix(acc * ODD + w[k:k + n] + U(k + 1))
        lengths = np.maximum(self.counts - (size - 1), 0)
        keep = np.ones(n, dtype=bool)
        for k in range(1, size):        # the last size - 1 words of each text start no run
            at = self.bounds[1:] - k
            at = at[(at >= self.bounds[:-1]) & (at < n)]
            keep[at] = False
        return acc[keep], np.concatenate([[0], np.cumsum(lengths)])


def word_slices(col: pa.Array, fold: bool) -> Iterator[Words]:
    """Consecutive slices of a string column, each about SLICE_BYTES long."""
    raw, offsets = string_buffers(col)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        lo, hi = int(offsets[i]), int(offsets[j])
        yield Words(raw[lo:hi], offsets[i:j + 1] - lo, i, fold)
        i = j


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer words than
    ``size`` is one shingle, a text without words has none."""
    hashes, bounds = words.windows(size)
    for d in range(len(words.counts)):
        n = int(words.counts[d])
        if n >= size:
            s = np.sort(hashes[bounds[d]:bounds[d + 1]])
            fresh = np.empty(len(s), dtype=bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            yield s[fresh]
        elif n:
            acc = np.array([n], np.uint64)
            for w in words.hashes[words.bounds[d]:words.bounds[d + 1]]:
                acc = mix(acc * ODD + w)
            yield acc
        else:
            yield np.zeros(0, np.uint64)
