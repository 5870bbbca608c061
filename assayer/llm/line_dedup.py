"""Removal of repeated multi-line chunks with content-defined boundaries.

A text is cut into lines at line feeds. Rolling hashes over the fingerprints of two neighbouring lines decide where chunks may begin (a line and the
one after it) and where they may end (a line and the one before it), so a chunk depends on its own lines only, and inserting or deleting lines moves the
boundaries next to the change and no others. Every seed gives another set of boundaries; a chunk goes from a beginning to the
first end after it, over two lines or more. Chunks that occurred before anywhere (in another document or in the same one) are removed.
Equal fingerprints only select candidates: occurrences count as equal when their bytes are. Bytes are compared line by line, once for all chunks: where no two
different lines share a 64-bit fingerprint, the fingerprints of a chunk's lines stand for its bytes; else the bytes of whole chunks are compared.

``dedup_passages`` needs no boundaries: every two neighbouring lines are a window, and so is every line of more than ``LONG`` words.
All windows that occurred before go, so a repeated passage goes up to its last equal line, whatever stands around it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import text as tx
from assayer.llm.shared import small, stored

SEEDS = 8  # sets of boundaries; a chunk of two lines is one of some seed's with probability 1 - (3/4)^SEEDS
LETTER = 28  # bits of a line's fingerprint
LONG = 50  # words up to which a line that repeats without a neighbour stays


def _digest(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "replace")).digest()[:8]


_BLANK = re.compile(r"[ \t-\r]*")


def _chunks_of(digests: bytes, row: np.ndarray, blank: np.ndarray, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every chunk of many texts, whose lines follow each other; ``row`` is the text of a line."""
    f = (np.frombuffer(digests, dtype=">u8") >> np.uint64(64 - LETTER)).astype(np.int64)
    n = len(f)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = np.append(0, np.cumsum(~blank))
    inside = row[1:] == row[:-1]
    begins, ends = 3 * f[:-1] + f[1:], 5 * f[:-1] + f[1:]
    found = []
    for s in range(1, seeds + 1):
        first = np.flatnonzero(inside & ((begins >> s) & 1 == 0))
        last = np.flatnonzero(inside & ((ends >> s) & 1 == 0)) + 1
        at = np.searchsorted(last, first + 1)
        first, last = first[at < len(last)], last[at[at < len(last)]]
        same = row[first] == row[last]
        found.append(first[same] * n + last[same])
    i, j = np.divmod(np.unique(np.concatenate(found)), n)
    wide = full[j + 1] - full[i] > 1
    return i[wide], j[wide]


def chunks(lines: list[str], seeds: int) -> list[tuple[int, int]]:
    """First and last line of every chunk, in order. With f the fingerprint of a line, a chunk of seed s may begin at line i where bit s + 1 of 3 f(i) + f(i+1) is 0,
    and end at line j where bit s + 1 of 5 f(j-1) + f(j) is 0. A chunk holds two lines or more that are not blank."""
    blank = np.array([bool(_BLANK.fullmatch(line)) for line in lines])
    i, j = _chunks_of(b"".join(map(_digest, lines)), np.zeros(len(lines), dtype=np.int64), blank, seeds)
    return list(zip(i.tolist(), j.tolist()))


def _lines(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All lines, the text of each, and where the lines of each text begin."""
    split = [text.split("\n") for text in texts]
    size = np.array([len(x) for x in split], dtype=np.int64)
    return [line for x in split for line in x], np.repeat(np.arange(len(split)), size), np.cumsum(size) - size


def _chunk_spans(texts: list[str], seeds: int, whole: bool) -> Iterator[tuple]:
    lines, row, start = _lines(texts)
    digests = b"".join(map(_digest, lines))
    blank = np.array([bool(_BLANK.fullmatch(line)) for line in lines], dtype=bool)
    i, j = _chunks_of(digests, row, blank, seeds)
    for x, y, r, at in zip(i.tolist(), j.tolist(), row[i].tolist(), (i - start[row[i]]).tolist()):
        yield r, at, y - x + 1, "\n".join(lines[x : y + 1]) if whole else digests[8 * x : 8 * y + 8]


def _chunks(rows: DataFrame, seeds: int, wanted: DataFrame | None = None) -> DataFrame:
    """Chunks as spans whose ``body`` is the fingerprints of their lines."""
    return _spans(rows, lambda texts: _chunk_spans(texts, seeds, False), wanted, "binary")


def _chunk_texts(rows: DataFrame, seeds: int, wanted: DataFrame | None = None) -> DataFrame:
    """Chunks as spans whose ``body`` is their text."""
    return _spans(rows, lambda texts: _chunk_spans(texts, seeds, True), wanted)


def _single(rows: DataFrame, _: int, wanted: DataFrame | None = None) -> DataFrame:
    """Every line as a span."""

    def spans(texts: list[str]) -> Iterator[tuple]:
        lines, row, start = _lines(texts)
        return zip(row.tolist(), (np.arange(len(lines)) - start[row]).tolist(), repeat(1), lines)

    return _spans(rows, spans, wanted)


def _collide(rows: DataFrame) -> bool:
    """Whether two different lines share a fingerprint: the least and the greatest text of every fingerprint that repeats, combined in each task."""
    ends = _single(rows, 1, _repeated_keys(rows, _single, 1)).groupBy("key").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return not ends.where("low <> high").isEmpty()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def windows(text: str, long: int) -> Iterator[tuple[int, int, str]]:
    """First line, number of lines and bytes of every two neighbouring lines that are not both blank, and of every line of over ``long`` words."""
    lines = text.split("\n")
    blank = [not line.strip() for line in lines]
    for i, line in enumerate(lines):
        if len(line) > 2 * long and len(line.split()) > long:
            yield i, 1, line
        if i + 1 < len(lines) and not (blank[i] and blank[i + 1]):
            yield i, 2, line + "\n" + lines[i + 1]


def _spans(rows: DataFrame, spans: Callable[[list[str]], Iterator[tuple]], wanted: DataFrame | None, kind: str = "string") -> DataFrame:
    """``key`` of every span (text, first line, number of lines, body) that ``spans`` gives for some texts; with ``doc_id, th, first_line, n_lines, body`` if ``wanted`` keys are given."""
    with_body = wanted is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.portions(batches):
            row, first, many, key, body = [], [], [], [], []
            for i, at, n, lines in spans([text or "" for text in batch.column("text").to_pylist()]):
                raw = lines if kind == "binary" else lines.encode("utf-8", "replace")
                key.append(int.from_bytes(hashlib.md5(raw).digest()[:8], "big", signed=True))
                if with_body:
                    row.append(i), first.append(at), many.append(n), body.append(lines)
            columns, names = [pa.array(key, pa.int64())], ["key"]
            if with_body:
                take = pa.array(row, pa.int64())
                columns += [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(first, pa.int64()), pa.array(many, pa.int64()), pa.array(body, kind)]
                names += ["doc_id", "th", "first_line", "n_lines", "body"]
            yield pa.RecordBatch.from_arrays(columns, names)

    if wanted is None:
        return rows.mapInArrow(tx.tidied(run), "key long")
    return rows.mapInArrow(tx.tidied(run), f"key long, doc_id long, th long, first_line long, n_lines long, body {kind}").join(small(wanted), "key", "left_semi")


def _repeated_keys(rows: DataFrame, spans: Callable[..., DataFrame], size: int) -> DataFrame:
    return stored(spans(rows, size).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated-keys")


def _windows(rows: DataFrame, long: int, wanted: DataFrame | None = None) -> DataFrame:
    return _spans(rows, lambda texts: ((i, *found) for i, text in enumerate(texts) for found in windows(text, long)), wanted)


def _repeated(rows: DataFrame, spans: Callable[..., DataFrame], size: int) -> DataFrame:
    """``doc_id, th, first_line, n_lines`` of the lines to remove, as runs that do not touch each other; ``th`` is xxhash64 of the text.

    A span goes if its bytes occurred before, by (doc_id, th, first_line) with nulls first, and do not overlap their first
    occurrence. So the first occurrence of a line never goes. Documents that repeat in all of doc_id and text are one document.
    """
    keys = _repeated_keys(rows, spans, size)
    place = F.struct("doc_id", "th", "first_line")
    bodies = stored(spans(rows, size, keys).distinct(), "bodies")
    first = stored(bodies.groupBy("key", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-bodies")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    apart = F.col("first_line") - F.col("first.first_line") >= F.col("n_lines")
    found = bodies.join(first, ["key", "body"]).where(~own | apart)
    by_text = Window.partitionBy("doc_id", "th").orderBy("first_line")
    before = F.max(F.col("first_line") + F.col("n_lines")).over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = found.withColumn("opens", F.when(F.col("first_line") <= before, 0).otherwise(1))
    runs = opens.withColumn("run", F.sum("opens").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(F.col("first_line") + F.col("n_lines"))
    least = F.min("first_line")
    return runs.groupBy("doc_id", "th", "run").agg(least.alias("first_line"), (end - least).alias("n_lines")).drop("run")


def repeated(docs: DataFrame, *, seeds: int = SEEDS) -> DataFrame:
    """Lines of chunks that occurred before, see ``_repeated``."""
    rows = _rows(docs)
    return _repeated(rows, _chunk_texts if _collide(rows) else _chunks, seeds)


def repeated_passages(docs: DataFrame, *, long: int = LONG) -> DataFrame:
    """Lines of windows that occurred before, see ``_repeated``."""
    return _repeated(_rows(docs), _windows, long)


def _without(docs: DataFrame, found: DataFrame, spare: float | None) -> DataFrame:
    ranges = stored(found, "ranges")
    lists = ranges.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("first_line", "n_lines"))).alias("gone"))  # within one text
    lists = small(stored(lists, "range-lists")) if ranges.count() <= 500_000 else lists
    names = [c for c in docs.columns if c != "removed_lines"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_th")
    )
    joined = rows.join(lists, rows.key_id.eqNullSafe(lists.doc_id) & (rows.key_th == lists.th), "left")
    text = F.col("row.text")
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(text, "\n", -1)))

    def between(k):
        """The lines after removed run k - 1 and before run k."""
        begin = F.when(k > 0, F.get("gone", k - 1)["first_line"] + F.get("gone", k - 1)["n_lines"]).otherwise(0)
        end = F.coalesce(F.get("gone", k)["first_line"], F.size("lines").cast("long"))
        return F.slice("lines", (begin + 1).cast("int"), (end - begin).cast("int"))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), between))
    out = F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n"))
    count = F.aggregate("gone", F.lit(0).cast("long"), lambda s, g: s + g["n_lines"])
    joined = joined.withColumn("left_over", out)
    if spare is not None:
        joined = joined.withColumn("left_over", F.when(F.length("left_over") >= (1 - spare) * F.length(text), F.col("left_over")))
    columns = [F.coalesce("left_over", text).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    removed = F.when(F.col("left_over").isNotNull(), count).otherwise(F.lit(0).cast("long"))
    return joined.select(*columns, removed.alias("removed_lines"))


def dedup_lines(docs: DataFrame, *, seeds: int = SEEDS, spare: float | None = None) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text``, and ``removed_lines`` (long) as last column.

    A null text stays null with 0 removed lines; a text of one line never changes; a text whose every line goes
    becomes empty. With ``spare``, a text that would lose more than that share of its characters stays whole: it is a copy rather than a text with a
    repeated passage. Rows that repeat doc_id and text all keep the same lines. Other columns pass through whatever their
    names; a column called ``removed_lines`` is replaced. An empty table gives an empty table.
    """
    return _without(docs, repeated(docs, seeds=seeds), spare)


def dedup_passages(docs: DataFrame, *, long: int = LONG, spare: float | None = None) -> DataFrame:
    """Like ``dedup_lines``, but without every run of two or more lines, and every line of more than ``long`` words, that occurred before."""
    return _without(docs, repeated_passages(docs, long=long), spare)
