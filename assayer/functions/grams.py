"""Word n-grams of whole Arrow columns: 64-bit hashes first, texts only of those that are wanted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from assayer.functions.tape import text_bytes, text_ends

PORTION = 1 << 18  # bytes of text hashed at once
U64 = np.uint64
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FIRST = 32  # letters of a word that are hashed for all words at once
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    for _ in range(2):
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and a hash of each that ignores the case of A-Z."""
    gap = GAP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    begin = np.flatnonzero(~gap & (np.append(True, gap[:-1]) | edge[:-1]))
    end = np.flatnonzero(~gap & (np.append(gap[1:], True) | edge[1:])) + 1
    value = mix(LOWER[data].astype(U64) + U64(1))
    length = end - begin
    hashes = np.zeros(len(begin), dtype=U64)
    live = np.arange(len(begin))
    for k in range(FIRST):  # one letter of every word that is long enough
        live = live[length[live] > k]
        if not len(live):
            break
        hashes[live] = (hashes[live] ^ value[begin[live] + k]) * U64(0x9DDFEA08EB382D69)
        hashes[live] ^= hashes[live] >> U64(29)
    for w in np.flatnonzero(length > FIRST).tolist():
        rest = hashlib.md5(LOWER[data[begin[w] + FIRST : end[w]]].tobytes()).digest()
        hashes[w] ^= U64(int.from_bytes(rest[:8], "little"))
    return begin, end, mix(hashes + length.astype(U64))


def hashed(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of a column: its first row, the bytes, begin and end of every word, and row and hash of every ``n`` words in a row (indexed by first word)."""
    off_all = text_ends(column)
    at = 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(off_all, off_all[at] + PORTION, "right")) - 1))
        data, off = text_bytes(column.slice(at, to - at))
        begin, end, words = _words(data, off)
        row = np.searchsorted(off, begin, "right") - 1
        m = len(begin) - n + 1
        if m > 0:
            whole = np.zeros(m, dtype=U64)
            for k in range(n):
                whole = mix(whole + words[k : k + m] + U64((_STEP * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
            inside = row[:m] == row[n - 1 :]
            yield at, data, begin, end, np.where(inside, row[:m], -1), whole
        at = to


def text_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: int, n: int) -> str:
    """The words of one n-gram, A-Z lower-cased, one space apart."""
    return b" ".join(LOWER[data[b:e]].tobytes() for b, e in zip(begin[first : first + n].tolist(), end[first : first + n].tolist())).decode("utf-8", "replace")
