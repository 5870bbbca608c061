"""Benchmark decontamination: BM25 over an inverted index of the test items, searched with block-max WAND.

Words are runs of letters and digits, A-Z lower-cased. Terms are word triples, so ordinary text rarely meets the index. Every training text is cut into overlapping passages; a
passage is the query, all items at or above the threshold are retrieved, and each is verified on the passage: enough of the question's
five-word shingles and enough of the answer's words must be there. An item's weights are divided by the least
score that a passage passing the verification can have, so the common threshold 1 loses none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import text as tx

TERM = 3  # words of an index term
SHINGLE = 5  # words of a shingle in the verification
SHARE = 0.8  # of the question's shingles, and of the answer's words
K1, B = 1.2, 0.75
BLOCK = 64  # postings that share one maximum
STOPS = list(b".!?\n")
ITEMS = 20_000  # of one index; more items are searched index by index


@dataclass
class Item:
    item_id: int
    question: np.ndarray  # distinct shingles
    answer: np.ndarray  # distinct words
    terms: np.ndarray  # distinct terms of the whole item
    asked: np.ndarray  # distinct terms inside the question
    n_words: int
    often: np.ndarray = field(default_factory=lambda: np.zeros(0))
    size: int = SHINGLE  # words of the question's shingles

    @property
    def span(self) -> int:
        """Words of a passage that is held against the item: three times its length, rounded up to a power of two. It depends on the item alone."""
        return 3 << (self.n_words - 1).bit_length()


def item_of(item_id: int, text: str | None) -> Item | None:
    """The answer is the last line or sentence, but a quarter of the words at most; the question is what comes before. An item of
    fewer than 2 x SHINGLE words has no answer of its own: all its words must follow each other in the passage. One of fewer than TERM words is too short
    to tell a leak from chance and gives None."""
    data, off = tx.texts(pa.array([text or ""]))
    hashes, rows, begin, end = tx.words(data, off, places=True, gaps=tx.MARKS)
    n = len(hashes)
    if n < TERM:
        return None
    if n < 2 * SHINGLE:
        terms, often = np.unique(tx.shingles(hashes, rows, TERM)[0], return_counts=True)
        return Item(item_id, tx.shingles(hashes, rows, n)[0], hashes[:0], terms, terms, n, often, n)
    stops = [i + 1 for i in range(n - 1) if np.isin(data[end[i] : begin[i + 1]], STOPS).any()]
    cut = max(stops[-1] if stops else 0, n - n // 4)
    terms, often = np.unique(tx.shingles(hashes, rows, TERM)[0], return_counts=True)
    one = np.zeros(cut, dtype=np.int32)
    return Item(
        item_id, np.unique(tx.shingles(hashes[:cut], one, SHINGLE)[0]), np.unique(hashes[cut:]), terms,
        np.unique(tx.shingles(hashes[:cut], one, TERM)[0]), n, often,
    )


class Index:
    """Postings per term in blocks with their largest weight."""

    def __init__(self, items: list[Item], frequency: dict[int, int], total: int, mean: float):
        self.items = items
        self.span = items[0].span if items else 0  # the same for all
        parts_t, parts_i, parts_w = [], [], []
        for place, item in enumerate(items):
            df = np.array([frequency[t] for t in item.terms.tolist()], dtype=float)
            idf = np.log1p((total - df + 0.5) / (df + 0.5))
            weight = idf * item.often * (K1 + 1) / (item.often + K1 * (1 - B + B * item.n_words / mean))
            asked = np.sort(weight[np.isin(item.terms, item.asked)])
            missing = int((1 - SHARE) * len(item.question)) + TERM - 1 if item.size == SHINGLE else 0
            least = asked[: max(1, len(asked) - missing)].sum()
            parts_t.append(item.terms), parts_i.append(np.full(len(df), place)), parts_w.append(weight / (0.999 * least))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        term, place, weight = join(parts_t, np.uint64), join(parts_i, np.int64), join(parts_w, np.float64)
        order = np.lexsort((place, term))
        self.item, self.weight = place[order], weight[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.find = tx.HashIndex(self.terms)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose summed weight over the distinct ``terms`` is at least 1 (block-max WAND)."""
        lists = [[int(self.first[t]), int(self.first[t + 1]), t] for t in terms]  # cursor, end, term
        starts = {t: int(self.first[t]) for t in terms}
        maxima: dict[tuple[int, int], float] = {}
        found = []
        while True:
            lists = [x for x in lists if x[0] < x[1]]
            lists.sort(key=lambda x: self.item[x[0]])
            bound, pivot = 0.0, -1
            for k, (at, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = self.item[lists[pivot][0]]
            while pivot + 1 < len(lists) and self.item[lists[pivot + 1][0]] == doc:
                pivot += 1
            bound, after = 0.0, None
            for at, end, t in lists[: pivot + 1]:
                # the block that could hold ``doc``
                block = starts[t] + (at - starts[t]) // BLOCK * BLOCK
                while block + BLOCK < end and self.item[min(block + BLOCK, end) - 1] < doc:
                    block += BLOCK
                stop = min(block + BLOCK, end)
                key = (t, block)
                if key not in maxima:
                    maxima[key] = float(self.weight[block:stop].max())
                bound += maxima[key]
                last = int(self.item[stop - 1])
                after = last if after is None else min(after, last)
            if bound < 1:
                # no item up to the end of the shortest block can reach the threshold with these terms alone
                goal = max(doc + 1, after + 1)
                if pivot + 1 < len(lists):
                    goal = min(goal, int(self.item[lists[pivot + 1][0]]))
                goal = max(goal, doc + 1)
                for x in lists[: pivot + 1]:
                    x[0] += int(np.searchsorted(self.item[x[0] : x[1]], goal))
                continue
            score = 0.0
            for x in lists[: pivot + 1]:
                x[0] += int(np.searchsorted(self.item[x[0] : x[1]], doc))
                if x[0] < x[1] and self.item[x[0]] == doc:
                    score += float(self.weight[x[0]])
                    x[0] += 1
            if score >= 1:
                found.append((int(doc), score))


def verify(item: Item, words: np.ndarray) -> tuple[float, float]:
    """Shares of the question's shingles and of the answer's words that a passage holds."""
    shingles = tx.shingles(words, np.zeros(len(words), dtype=np.int32), item.size)[0]
    return float(np.isin(item.question, shingles).mean()), float(np.isin(item.answer, words).mean()) if len(item.answer) else 1.0


def _indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """For every ITEMS items one index per length of passage, all with the statistics of the whole benchmark. Repeated rows are one item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    shards = max(1, -(-items.count() // ITEMS))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))

    def read(shard: int) -> list[Item]:
        rows = items.where(own == shard).collect()  # about ITEMS short texts
        rows.sort(key=lambda r: (r.item_id is not None, r.item_id or 0, r.text or ""))
        return [x for x in (item_of(r.item_id, r.text) for r in rows) if x]

    frequency: dict[int, int] = {}
    total = words = 0
    first: list[Item] = []
    for shard in range(shards):
        first = read(shard)
        total, words = total + len(first), words + sum(x.n_words for x in first)
        for item in first:
            for t in item.terms.tolist():
                frequency[t] = frequency.get(t, 0) + 1
    for shard in range(shards):
        part = first if shards == 1 else read(shard)
        by_span: dict[int, list[Item]] = {}
        for item in part:
            by_span.setdefault(item.span, []).append(item)
        if by_span:
            yield [Index(same, frequency, total, words / max(1, total)) for _, same in sorted(by_span.items())]


def matches(indexes: list[Index], column: pa.Array) -> Iterator[tuple[int, int | None, float, int, float, float]]:
    """Row, item, score, first word of the passage and both overlaps, for each verified pair once (its best passage)."""
    hashes, rows = tx.words(*tx.texts(column), gaps=tx.MARKS)
    terms, first = tx.shingles(hashes, rows, TERM)
    for index in indexes:
        for row, place, *found in _matches(index, hashes, rows, terms, first):
            yield row, index.items[place].item_id, *found


def _matches(index: Index, hashes: np.ndarray, rows: np.ndarray, terms: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, float, float]]:
    span = index.span  # a passage; they begin half a passage apart
    step = span // 2
    got = index.find.find(terms)
    hit = np.flatnonzero(got >= 0)
    if not len(hit):
        return
    got, first = got[hit].astype(np.int64), first[hit]
    row = rows[first]
    start = np.searchsorted(rows, row, "left")
    cell = (first - start) // step
    weight = index.most[got]
    # upper bounds of all passages at once: a passage covers two cells, less what reaches over its end
    key = row.astype(np.int64) * (1 << 32) + cell
    cells, where = np.unique(key, return_index=True)
    sums = np.add.reduceat(weight, where)
    ends = np.append(where[1:], len(key))
    following = np.append(cells[1:] == cells[:-1] + 1, False)
    both = sums + np.where(following, np.append(sums[1:], 0), 0)
    leading = ~np.append(False, cells[1:] == cells[:-1] + 1) & (cells & 0xFFFFFFFF > 0)
    best: dict[tuple[int, int], tuple] = {}
    for k in np.flatnonzero((both >= 1) | leading & (sums >= 1)):
        for back in (1, 0) if leading[k] else (0,):
            r, c = int(cells[k] >> 32), int(cells[k] & 0xFFFFFFFF) - back
            to = ends[k + 1] if not back and following[k] else ends[k]
            begin = int(start[where[k]]) + c * step
            stop = min(begin + span, int(np.searchsorted(rows, r, "right")))
            inside = first[where[k] : to] + TERM <= stop
            for place, score in index.search(sorted(set(got[where[k] : to][inside].tolist()))):
                question, answer = verify(index.items[place], hashes[begin:stop])
                if question >= SHARE and answer >= SHARE and best.get((r, place), (-1,))[0] < score:
                    best[r, place] = (score, c * step, question, answer)
    for (r, place), found in best.items():
        yield r, place, *found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, th, item_id, score, first_word, question_overlap, answer_overlap`` of every verified leak.

    Reads ``doc_id`` and ``text`` of ``docs`` and ``item_id`` and ``text`` of ``benchmark``; other columns are ignored. ``th`` is xxhash64 of the
    document's text. ``score`` is BM25 over the item's threshold (1 or more). Items of three to nine words match where their whole word sequence stands; null and empty
    texts, and items of fewer words, match nothing. Which pairs are found depends on the document and the item alone. Repeated documents each get their rows. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, th long, item_id long, score double, first_word long, question_overlap double, answer_overlap double"
    # an empty list of rows would start Python workers of another kind on every executor, which stay
    out = rows.where(F.lit(False)).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in kind.split(", "))])
    for built in _indexes(benchmark):
        index = spark.sparkContext.broadcast(built)  # of at most ITEMS items

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in tx.portions(batches, limit=tx.SHORT):
                found = list(matches(index.value, batch.column("text")))
                row, items, score, word, question, answer = zip(*found) if found else ((),) * 6
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(items, pa.int64()), pa.array(score, pa.float64()), pa.array(word, pa.int64()), pa.array(question, pa.float64()), pa.array(answer, pa.float64())],
                    ["doc_id", "th", "item_id", "score", "first_word", "question_overlap", "answer_overlap"],
                )

        out = out.union(rows.mapInArrow(tx.tidied(run), kind))
    return out
