"""Periodic runs of words, found as maximal pairs on an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and at least ``exponent`` periods and ``least`` words, that no
neighbouring word extends. The places s and s + q of a run are a maximal pair: the words from there on agree for the run's length less q,
the words before them and the words after them differ. So every pair of places whose common part is long enough for its distance
is a run as it stands, and nothing is extended.

The pairs of one text come from its suffixes in sorted order. Joining neighbours from the longest common prefix down walks the LCP-interval
tree bottom-up; every set of suffixes keeps its places sorted, as a whole and by the word before them (left-word classes). When two sets
meet at depth d, each place of the smaller one looks for places of another class in the larger one, not further than d / (exponent - 1). Parts of the tree
above the least useful depth, and those with a single class, have no such pair and are never built.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import text as tx

LEAST = 6  # words of a run
EXPONENT = 4  # periods of a run
SPAN = 10  # bits of a place inside its bucket
RUN = "struct<start:long,length:long,period:long>"


class Places:
    """A set of numbers in buckets of neighbouring values, so that an insertion moves at most 2^SPAN of them."""

    def __init__(self, first: int):
        self.buckets = {first >> SPAN: [first]}

    def add(self, i: int) -> None:
        insort(self.buckets.setdefault(i >> SPAN, []), i)

    def __iter__(self) -> Iterator[int]:
        for bucket in self.buckets.values():
            yield from bucket

    def _within(self, lo: int, hi: int):
        """Buckets with a number from ``lo`` to ``hi``, and which part of each lies there."""
        a, b = lo >> SPAN, hi >> SPAN
        for k in range(a, b + 1) if b - a < len(self.buckets) else [k for k in self.buckets if a <= k <= b]:
            bucket = self.buckets.get(k)
            if bucket:
                yield bucket, bisect_left(bucket, lo), bisect_right(bucket, hi)

    def count(self, lo: int, hi: int) -> int:
        return sum(y - x for _, x, y in self._within(lo, hi))

    def between(self, lo: int, hi: int) -> Iterator[int]:
        for bucket, x, y in self._within(lo, hi):
            yield from bucket[x:y]


class Node:
    """Suffixes below one node of the tree: their places, and the places by left word."""

    def __init__(self, place: int, left: int):
        self.size, self.all, self.classes = 1, Places(place), {left: Places(place)}

    def add(self, place: int, left: int) -> None:
        self.size += 1
        self.all.add(place)
        if left in self.classes:
            self.classes[left].add(place)
        else:
            self.classes[left] = Places(place)

    def others(self, place: int, left: list[int], reach: int) -> Iterator[int]:
        """Places of another class at most ``reach`` away: by class, or through the window if that holds fewer places than there are classes."""
        lo, hi = max(0, place - reach), place + reach
        if self.all.count(lo, hi) <= len(self.classes):
            yield from (j for j in self.all.between(lo, hi) if left[j] != left[place])
            return
        for word, places in self.classes.items():
            if word != left[place]:
                yield from places.between(lo, hi)


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in sorted order, and the common prefix of each with the one before (0 for the first). Prefix doubling keeps
    the ranks of every power of two, and the common prefixes are read off them."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while len(ranks) < 2 or int(ranks[-1].max()) + 1 < n:
        now, step = ranks[-1], 1 << (len(ranks) - 1)
        if int(now.max()) + 1 == n:
            break
        following = np.zeros(n, dtype=np.int64)
        following[: max(0, n - step)] = now[step:] + 1
        ranks.append(np.unique(now * (n + 1) + following, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(ranks[-1])
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1], order[1:]
    length = np.zeros(n - 1, dtype=np.int64)
    for k in reversed(range(len(ranks))):
        inside = np.maximum(a, b) + length + (1 << k) <= n
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += np.where(inside & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
    common[1:] = length
    return order, common


def depth_of(least: int, exponent: int) -> int:
    """The least common part of a pair that is a run."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))


def _useful(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places whose next ``depth`` words occur again after another left word."""
    n = len(words) - depth + 1
    if n < 2:
        return np.zeros(0, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(depth):
        key = tx.mix(key + words[k : k + n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    if len(begins) == n:
        return np.zeros(0, dtype=np.int64)
    own = left[order]
    size = np.diff(np.append(begins, n))
    mixed = np.maximum.reduceat(own, begins) != np.minimum.reduceat(own, begins)
    return order[np.repeat(mixed & (size > 1), size)]


def runs_of(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` (numbers that stand for words), by start and period."""
    n, depth = len(words), depth_of(least, exponent)
    if n < least:
        return []
    left = np.append(-1, words[:-1])
    useful = _useful(words, left, depth)
    if not len(useful):
        return []
    order, common = suffixes(words)
    wanted = np.zeros(n, dtype=bool)
    wanted[useful] = True
    before = left.tolist()
    found: dict[tuple[int, int], int] = {}  # start and end: period

    def join(a: Node, b: Node, d: int) -> Node:
        small, large = (a, b) if a.size < b.size else (b, a)
        reach = d // (exponent - 1)
        mixed = len(small.classes) > 1 or len(large.classes) > 1 or small.classes.keys() != large.classes.keys()
        if mixed:
            for i in small.all:
                for j in large.others(i, before, reach):
                    q, s = abs(i - j), min(i, j)
                    if q + d >= least:
                        found[s, s + q + d] = min(q, found.get((s, s + q + d), q))
        for i in small.all:
            large.add(i, before[i])
        return large

    stack: list[tuple[int, Node]] = []
    node = None
    for i, d in zip(order.tolist(), common.tolist()):
        if not wanted[i]:
            continue
        if node is not None:
            d = d if d >= depth else 0
            while stack and stack[-1][0] >= max(d, 1):
                above, other = stack.pop()
                node = join(other, node, above)
            if d:
                stack.append((d, node))
        node = Node(i, before[i])
    while stack:
        above, other = stack.pop()
        node = join(other, node, above)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def find_runs(docs: DataFrame, *, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every text: its runs by start and period, and its words without repeated periods, one space apart.

    Words are runs of bytes other than space and 0x09-0x0D, compared as they are. A null or empty text has no words, no runs and an empty ``collapsed``. Each
    row gives one row, also if ids are null or repeat; other columns are ignored. Texts are handled one at a time, so work and memory of
    a task follow its longest text. ``exponent`` is 2 or more. An empty table gives no rows.
    """
    if exponent < 2:
        raise ValueError("a run has two periods or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.portions(batches):
            data, off = tx.texts(batch.column("text"))
            raw = data.tobytes()
            counts, lists, texts = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                words = raw[a:b].split()
                numbers: dict[bytes, int] = {}
                found = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64), least, exponent)
                counts.append(len(words))
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed(words, found)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run with the greatest exact exponent (ties: smallest start, then period), and sha256 of all runs and of the collapsed text."""
    first = F.aggregate(
        "runs", F.lit(None).cast(RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    rows = found.withColumn("best", first)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
