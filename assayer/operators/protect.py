"""Protected spellings in untrusted text, found by an Aho-Corasick automaton, and the ids that stand for them."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from assayer.session import package_path

SPANS = "array<struct<start:int,stop:int,id:int>>"
BYTES = 256
PORTION = 500_000  # tokens replaced at once


def _automaton(spellings: dict[str, int]) -> ahocorasick.Automaton:
    if not spellings or not all(spellings):
        raise ValueError("protected spellings must not be empty")
    found = ahocorasick.Automaton()
    for spelling, number in spellings.items():
        found.add_word(spelling, (len(spelling), number))
    found.make_automaton()
    return found


def _occurrences(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, int]]:
    """Start, stop and id of every occurrence, overlapping ones too."""
    for last, (size, number) in automaton.iter(text):
        yield last + 1 - size, last + 1, number


def protected_spans(text: Column, spellings: dict[str, int]) -> Column:
    """Every occurrence of a protected spelling, by start and stop in characters; overlapping ones are all there. NULL has none."""

    def run(texts: pa.Array) -> pa.Array:
        automaton = _automaton(spellings)
        size, found = [0], array("i")  # plain numbers: a batch can hold millions of spans
        for t in texts:
            for span in sorted(_occurrences(automaton, t.as_py() or "")):
                found.extend(span)
            size.append(len(found) // 3)
        flat = np.frombuffer(found, dtype=np.int32).reshape(-1, 3)
        return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "stop", "id"]))

    _automaton(spellings)
    package_path(SparkSession.getActiveSession())
    return F.arrow_udf(run, SPANS)(text)


def neutralized(tokens: Column, text: Column, spellings: dict[str, int], *, protected: frozenset[int] = frozenset(), byte_base: int = 0) -> Column:
    """Ids of ``tokens`` (ARRAY<STRUCT<id, start, stop>>, offsets in characters) without any protected one.

    A token whose id is protected must cover one occurrence of that id's spelling and becomes one id per UTF-8 byte of it, counted from ``byte_base``. A
    protected id anywhere else, also one without a spelling, is an error, as is a byte's id that is protected itself. Texts without a protected id
    pass as they are, whatever they spell. NULL tokens stay NULL.
    """
    every = frozenset(spellings.values()) | protected
    if any(byte_base <= x < byte_base + BYTES for x in every):
        raise ValueError("an id of a byte is protected")

    def portions(tokens: pa.Array) -> Iterator[slice]:
        ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(tokens):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
            yield slice(at, to)
            at = to

    def run(tokens: pa.Array, texts: pa.Array) -> pa.Array:
        tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
        parts = [replaced(tokens[part], texts[part]) for part in portions(tokens)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def replaced(tokens: pa.Array, texts: pa.Array) -> pa.Array:
        size = np.where(tokens.is_null().to_numpy(zero_copy_only=False), 0, tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        inner = tokens.flatten()
        ids, start, stop = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        hit = np.flatnonzero(np.isin(ids, list(every)))
        row = np.repeat(np.arange(len(size)), size)
        count = np.ones(len(ids), dtype=np.int64)
        pieces: dict[int, bytes] = {}
        if len(hit):
            automaton = _automaton(spellings)
            for r in np.unique(row[hit]).tolist():
                text = texts[r].as_py() or ""
                spans = set(_occurrences(automaton, text))
                for k in hit[row[hit] == r].tolist():
                    if (int(start[k]), int(stop[k]), int(ids[k])) not in spans:
                        raise ValueError("protected token is not a literal source span")
                    pieces[k] = text[start[k] : stop[k]].encode()
                    count[k] = len(pieces[k])
        out = np.repeat(ids, count)
        first = np.cumsum(count) - count
        for k, raw in pieces.items():
            out[first[k] : first[k] + len(raw)] = np.frombuffer(raw, dtype=np.uint8).astype(np.int64) + byte_base
        total = np.bincount(row, count, len(size)).astype(np.int64) if len(row) else np.zeros(len(size), np.int64)
        offsets = pa.array(np.append(0, np.cumsum(total)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.astype(np.int32)), mask=tokens.is_null())

    package_path(SparkSession.getActiveSession())
    return F.arrow_udf(run, "array<int>")(tokens, text)
