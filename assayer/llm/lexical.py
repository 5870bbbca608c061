"""Ranked lexical search over inverted lists in geometric blocks.

Texts become sparse vectors over the terms that the queries use. A task takes its vectors in segments. In a segment, a term's posting list is cut
into blocks of documents that lie close together (by the direction of a random projection of their vectors), and every block has a summary: for
each term the largest impact among its documents. A query goes through the lists of its terms, the one with the largest possible
contribution first. The summary bounds what a document of a block can score with the terms from this list on; documents with an earlier term
were met before. A block is skipped only if that bound lies below the score that the query's last place has already, and the lists end where all remaining
terms together lie below it. So the result is exact. The best of all tasks meet in one ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import text as tx
from assayer.llm.shared import stored

TOP = 20
ITEMS = 2_000  # queries of one pass over the texts; more take several
SEGMENT = 2_048  # documents of a segment
ENTRIES = 1_000_000  # of its vectors, at most this many and one document's
BLOCK = 64  # documents of a block, about
DIMENSIONS = 32  # of the projection
KEPT = 64 << 20  # bytes of summaries that a segment keeps; beyond that they are built again
NO_ID = -(1 << 63)


@dataclass
class Queries:
    """Terms of the queries, numbered by fingerprint, and each query's distinct terms with their numbers of occurrences."""

    ids: list[int | None]
    terms: list[np.ndarray]
    often: list[np.ndarray]
    known: np.ndarray
    weight: np.ndarray | None = None  # of each term, when counted
    total: int = 0
    length: int = 0


def queries_of(rows: list[tuple[int | None, str | None]]) -> Queries:
    """Rows that share an id are one query with the terms of all of them; a query without terms is left out."""
    data, off = tx.texts(pa.array([text for _, text in rows], pa.string()))
    hashes, row = tx.words(data, off, gaps=tx.MARKS)
    known, code = np.unique(hashes, return_inverse=True)
    by_id: dict[int | None, list[np.ndarray]] = {}
    for k, (item, _) in enumerate(rows):
        a, b = np.searchsorted(row, [k, k + 1])
        if b > a:
            by_id.setdefault(item, []).append(code[a:b])
    found = {item: np.unique(np.concatenate(parts), return_counts=True) for item, parts in by_id.items()}
    return Queries(list(found), [t for t, _ in found.values()], [n for _, n in found.values()], known)


def vectors(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, counts`` of every text that has a term: its number of terms, and which of the ``known`` ones it holds how often."""
    table = docs.sparkSession.sparkContext.broadcast(known)  # terms of ITEMS queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = tx.HashIndex(table.value)
        width = max(1, len(table.value))
        for batch in tx.portions(batches):
            hashes, row = tx.words(*tx.texts(batch.column("text")), gaps=tx.MARKS)
            n = np.bincount(row, minlength=len(batch))
            place = index.find(hashes)
            hit = place >= 0
            key, count = np.unique(row[hit].astype(np.int64) * width + place[hit], return_counts=True)
            bounds = np.searchsorted(key // width, np.arange(len(batch) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (key % width, count)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weigh(queries: Queries, found: DataFrame) -> None:
    """Number and total length of the documents, and the weight of every term."""
    total = found.agg(F.count("*"), F.sum("n")).first()
    queries.total, queries.length = total[0], total[1] or 0
    holders = np.zeros(len(queries.known), dtype=np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the known terms
        holders[term] = n
    queries.weight = np.array([math.floor(1000 * math.log((2 * queries.total + 2) / (2 * df + 1))) for df in holders.tolist()], dtype=np.int64)


def impacts(counts: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What one unit of weight brings a document of ``n`` terms that holds the term ``counts`` times."""
    m = 75 + 25 * n * total // length
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Blocks:
    """A posting list: documents by block, and the summaries by term (block and largest impact, term after term)."""

    docs: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray

    def bound(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Largest score with these terms in each block."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        got = np.flatnonzero(self.terms[at] == terms)
        begin = self.first[at[got]]
        size = self.first[at[got] + 1] - begin
        where = _ranges(begin, size)
        out = np.zeros(len(self.bounds) - 1, dtype=np.int64)
        np.add.at(out, self.block[where], np.repeat(weight[got], size) * self.most[where])
        return out


class Segment:
    """Vectors of some documents, with blocked posting lists built when a query comes to them."""

    def __init__(self, keys: np.ndarray, size: np.ndarray, terms: np.ndarray, impact: np.ndarray):
        self.keys, self.size, self.impact = keys, size, impact
        self.first = np.cumsum(size) - size
        self.terms, self.term = np.unique(terms, return_inverse=True)
        order = np.argsort(self.term, kind="stable")
        self.posting = np.repeat(np.arange(len(size)), size)[order]
        self.bounds = np.searchsorted(self.term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(impact[order], self.bounds[:-1]) if len(terms) else np.zeros(0, np.int64)
        code = tx.mix(self.terms.astype(np.uint64) + np.uint64(1))[self.term]
        cell = np.repeat(np.arange(len(size)), size) * DIMENSIONS + (code % np.uint64(DIMENSIONS)).astype(np.int64)
        sign = np.where(code >> np.uint64(63), 1.0, -1.0)
        sums = np.bincount(cell, sign * impact, len(size) * DIMENSIONS).reshape(-1, DIMENSIONS)
        self.direction = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.built: dict[int, Blocks] = {}
        self.bytes = 0
        self.weights = np.zeros(len(self.terms), dtype=np.int64)
        self.skipped = self.opened = 0

    def blocks(self, t: int) -> Blocks:
        if t in self.built:
            return self.built[t]
        docs = self.posting[self.bounds[t] : self.bounds[t + 1]]
        number = -(-len(docs) // BLOCK)
        if number > 1:
            centers = self.direction[docs[np.arange(number) * len(docs) // number]]
            own = np.argmax(self.direction[docs] @ centers.T, axis=1)
            order = np.argsort(own, kind="stable")
            docs, own = docs[order], own[order]
            own = np.unique(own, return_inverse=True)[1]
            number = int(own[-1]) + 1
        else:
            own = np.zeros(len(docs), dtype=np.int64)
        size = self.size[docs]
        where = _ranges(self.first[docs], size)
        table = np.zeros(len(self.terms) * number, dtype=np.int64)
        np.maximum.at(table, self.term[where] * number + np.repeat(own, size), self.impact[where])
        cell = np.flatnonzero(table)
        terms, first = np.unique(cell // number, return_index=True)
        found = Blocks(docs, np.searchsorted(own, np.arange(number + 1)), terms, np.append(first, len(cell)), (cell % number).astype(np.int32), table[cell])
        cost = 12 * len(cell) + 24 * len(terms) + 8 * len(docs)
        if self.bytes + cost > KEPT:
            self.built.clear()
            self.bytes = 0
        self.built[t] = found
        self.bytes += cost
        return found

    def search(self, terms: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best so far and of this segment's documents, highest first, ties by id."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        here = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, np.int64)
        here = here[weight[here] > 0]
        if not len(here):
            return best
        term, weight = at[here], weight[here]
        most = weight * self.most[term]
        order = np.argsort(-most, kind="stable")
        term, weight, most = term[order], weight[order], most[order]
        rest = np.cumsum(most[::-1])[::-1]
        self.weights[term] = weight
        seen = np.zeros(len(self.size), dtype=bool)
        scores, ids = best
        least = int(scores[top - 1]) if len(scores) >= top else 1
        for k in range(len(term)):
            if rest[k] < least:
                break
            found = self.blocks(int(term[k]))
            bound = found.bound(term[k:], weight[k:])
            line = np.argsort(-bound, kind="stable")
            done, step = 0, 1
            while done < len(line):
                part = line[done : done + step]
                part = part[bound[part] >= least]
                if not len(part):
                    break
                done, step = done + step, step * 2
                self.opened += len(part)
                docs = found.docs[_ranges(found.bounds[part], found.bounds[part + 1] - found.bounds[part])]
                docs = docs[~seen[docs]]
                if not len(docs):
                    continue
                seen[docs] = True
                size = self.size[docs]
                where = _ranges(self.first[docs], size)
                score = np.add.reduceat(self.weights[self.term[where]] * self.impact[where], np.cumsum(size) - size)
                good = score >= least
                if good.any():
                    scores, ids = np.append(scores, score[good]), np.append(ids, self.keys[docs[good]])
                    keep = np.lexsort((ids, -scores))[:top]
                    scores, ids = scores[keep], ids[keep]
                    least = int(scores[top - 1]) if len(scores) >= top else 1
            self.skipped += max(0, len(line) - done)
        self.weights[term] = 0
        return scores, ids


def _segments(batches: Iterator[pa.RecordBatch], total: int, length: int) -> Iterator[Segment]:
    """Segments of at most SEGMENT documents and about ENTRIES entries; documents that hold no known term are in none."""
    held: list[tuple] = []
    docs = entries = 0

    def close() -> Segment:
        return Segment(*(np.concatenate(x) for x in zip(*held)))

    for batch in batches:
        terms, counts = batch.column("terms"), batch.column("counts")
        size = np.diff(terms.offsets.to_numpy())
        keys = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        flat, often = (x.flatten().to_numpy().astype(np.int64) for x in (terms, counts))
        impact = impacts(often, np.repeat(batch.column("n").to_numpy(), size), total, length)
        first = np.cumsum(size) - size
        at = 0
        while at < len(size):
            room = int(np.searchsorted(first + size, first[at] + max(1, ENTRIES - entries), "right"))
            to = min(len(size), at + SEGMENT - docs, max(at + 1, room))
            own = size[at:to] > 0
            a, b = int(first[at]), int(first[to - 1] + size[to - 1])
            held.append((keys[at:to][own], size[at:to][own], flat[a:b], impact[a:b]))
            docs, entries, at = docs + to - at, entries + b - a, to
            if docs >= SEGMENT or entries >= ENTRIES:
                yield close()
                held, docs, entries = [], 0, 0
    if held:
        yield close()


def search(found: DataFrame, queries: Queries, top: int = TOP) -> DataFrame:
    """``item_id, doc_id, score``: each query's best documents of every task."""
    shared = found.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        weight = [q.weight[t] * n for t, n in zip(q.terms, q.often)]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q.ids)
        for segment in _segments(batches, q.total, q.length):
            for k, terms in enumerate(q.terms):
                best[k] = segment.search(terms, weight[k], best[k], top)
        size = [len(s) for s, _ in best]
        if sum(size):
            item = pa.array(q.ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(size)), size)))
            ids = np.concatenate([x for _, x in best])
            columns = [item, pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([s for s, _ in best]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])
        tx.release()

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, *, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``top`` documents with the highest score above 0, equal scores by doc_id, nulls first.

    Reads ``doc_id`` and ``text`` of ``docs``, ``item_id`` and ``text`` of ``items``; other columns are ignored. Terms are runs of ASCII letters and digits and of
    all characters beyond ASCII, A-Z lower-cased. Every row of ``docs`` is a document of its own, also if ids repeat or are null. Rows of ``items`` that
    share an id are one item with the distinct texts of them all. Null and empty texts have no terms; items without terms, and empty tables on either side, give no rows.
    Only the terms of ITEMS items, their counts and weights are held by the driver and every task. Terms meet by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    shards = max(1, -(-asked.count() // ITEMS))
    own = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for shard in range(shards):
        rows = asked.where(own == shard).collect()  # about ITEMS texts
        queries = queries_of(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
        if queries.ids:
            found = stored(vectors(docs, queries.known), "vectors")
            weigh(queries, found)
            out = out.union(search(found, queries, top))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
