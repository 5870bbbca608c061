"""Texts of Arrow batches as byte arrays, words with 64-bit fingerprints, and a hash index.

Everything here works on one Arrow batch inside a task. A word is a run of bytes other than space and
0x09-0x0D; its fingerprint ignores the case of A-Z. Work arrays cover ``BLOCK`` bytes at a time, however
long a text is; what a batch keeps is one fingerprint and one row number per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SHORT = 1 << 18  # bytes of a portion where many tasks of a long job share an executor
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = SPACE.copy()  # also ASCII punctuation and control characters
MARKS[[x for x in range(128) if not chr(x).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.where(SPACE, U64(0), _random(256, 1)[LOWER])
_BASE = 0x9DDFEA08EB382D69  # odd, so that it has an inverse modulo 2^64


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        table = np.full(n, base, dtype=U64)
        table[0] = 1
        out.append(np.cumprod(table))
    return out[0], out[1]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and the n + 1 places where they begin. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, off - off[0]


def release() -> None:
    """Give freed memory back to the system: Spark reuses Python workers, and all of an executor's share its limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps or returns it as it likes
        pass


def tidy(batches: Iterator) -> Iterator:
    """The same batches, with ``release`` when the task is done."""
    try:
        yield from batches
    finally:
        release()


def tidied(run):
    """``run`` over a task's batches, with ``release`` after its last work arrays are gone."""
    return lambda batches: tidy(run(batches))


def portions(batches: Iterator[pa.RecordBatch], column=lambda batch: batch.column("text"), limit: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or one row, so that a task's work arrays stay small."""
    for batch in batches:
        if not len(batch):
            continue
        off = texts(column(batch))[1]
        at = 0
        while at < len(batch):
            to = min(len(batch), max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to
        del batch, off
    release()


def blocks(data: np.ndarray, off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``limit`` bytes that end at a space or at the end of a text; a longer word is
    one range."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + limit)
        if to < n:
            cut = off[np.searchsorted(off, to, "right") - 1]
            gaps = np.flatnonzero(SPACE[data[max(at, int(cut)) : to]])
            if len(gaps):
                to = max(at, int(cut)) + int(gaps[-1]) + 1
            elif cut > at:
                to = int(cut)
            else:
                stop = int(off[np.searchsorted(off, to, "left")])
                step = to
                while step < stop:
                    gaps = np.flatnonzero(SPACE[data[step : min(stop, step + limit)]])
                    if len(gaps):
                        stop = step + int(gaps[0]) + 1
                    step += limit
                to = stop
        yield at, to
        at = to


def words(data: np.ndarray, off: np.ndarray, places: bool = False, gaps: np.ndarray = SPACE):
    """Fingerprint and row of every word, in order; with ``places`` also where it begins and ends. ``gaps`` marks the bytes
    between words (at least those of SPACE)."""
    hashes, rows, begin, end = [], [], [], []
    for at, to in blocks(data, off):
        part = data[at:to]
        n = to - at
        gap = gaps[part]
        first, last = np.searchsorted(off, at, "left"), np.searchsorted(off, to, "right")
        cuts = off[first:last] - at
        before = np.ones(n, dtype=bool)
        before[1:] = gap[:-1]
        before[cuts[cuts < n]] = True
        after = np.ones(n, dtype=bool)
        after[:-1] = gap[1:]
        after[cuts[cuts > 0] - 1] = True
        b = np.flatnonzero(before & ~gap)
        e = np.flatnonzero(after & ~gap) + 1
        size = SHORT if n <= SHORT else BLOCK if n <= BLOCK else 1 << (n - 1).bit_length()
        power, inverse = _powers(size)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[part] * power[:n], out=sums[1:])
        hashes.append(mix((sums[e] - sums[b]) * inverse[b]))
        rows.append((np.searchsorted(off, b + at, "right") - 1).astype(np.int32))
        if places:
            begin.append(b + at)
            end.append(e + at)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
    out = join(hashes, U64), join(rows, np.int32)
    return (*out, join(begin, np.int64), join(end, np.int64)) if places else out


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every ``size`` words in a row, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    inside = np.flatnonzero(rows[:n] == rows[size - 1 :])
    factor = _random(size, 7) | U64(1)
    out = np.zeros(len(inside), dtype=U64)
    for k in range(size):
        out += hashes[inside + k] * factor[k]
    return mix(out), inside


class HashIndex:
    """Places of distinct 64-bit keys, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=U64)
        self.bits = max(4, (4 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = np.asarray(keys, dtype=U64)
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        at = self._home(keys)
        got = self.slots[at]
        hit = (got >= 0) & (self.keys[got] == keys)
        out[hit] = got[hit]
        left = np.flatnonzero((got >= 0) & ~hit)
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            on = (got >= 0) & ~hit
            left, at = left[on], at[on]
        return out
