"""Whole-batch word kernel: words, word hashes and word n-grams of Arrow string columns, as NumPy arrays.

A word is a maximal run of bytes outside ``SEPARATORS`` (space and 0x09-0x0D), which for UTF-8 equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on code points. No Python object is made for a word: a batch is one byte array,
and hashes of all its words come from one running sum. Hashes are 64 bits; callers that need exact answers
verify, or state the collision bound.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Returns freed memory to the system. Workers are reused, and what each has once needed would otherwise stay with it
    while others and the JVM need theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function over Arrow batches that gives memory back at the end of each task."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


U64 = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
GRAM = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(fold_ascii: bool = False) -> np.ndarray:
    """A 64-bit value for each byte; with ``fold_ascii``, A-Z have those of a-z."""
    table = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0xA0761D6478BD642F)) | U64(1)
    if fold_ascii:
        table[65:91] = table[97:123]
    return table


PLAIN, FOLDED = byte_table(), byte_table(fold_ascii=True)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all the texts, one after another, and len + 1 offsets. A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``limit`` bytes at most, or one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = stop


class Words:
    """The words of some texts: ``starts`` and ``ends`` in ``data``, ``first`` (len + 1): each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SEPARATORS[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def hashes(self, table: np.ndarray = PLAIN, starts: np.ndarray | None = None, ends: np.ndarray | None = None, data: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word, or of other ranges of bytes."""
        starts, ends = self.starts if starts is None else starts, self.ends if ends is None else ends
        data = self.data if data is None else data
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def rows_of(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Words]]:
    """(number of the first row, words) of blocks of rows."""
    data, offsets = text_arrays(column)
    for start, stop in blocks(offsets, limit):
        yield start, Words(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k hashes in a row, text ends not regarded; has max(0, n - k + 1) entries."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, U64)
    for j in range(k):
        out *= GRAM
        out += hashes[j : n + j]
    return mix(out)


def whole(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the k-word windows that lie in one text."""
    at = np.flatnonzero(words.room() >= k)
    return at, grams(hashes, k)[at]


def cover(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of ``first``."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, np.minimum(first + k, n), -1)
    return np.cumsum(edges[:-1]) > 0


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """For each value its place in the sorted set, or -1."""
    if not len(sorted_set):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return np.where(sorted_set[at] == values, at, -1)
