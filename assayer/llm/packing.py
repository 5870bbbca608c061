"""Best-fit packing of tokenized documents after a dominance reduction.

The plan depends only on how many pieces there are of each length, a table of at most ``capacity`` rows. That histogram is reduced
first: sets that provably dominate every other set with the same largest piece are fixed for good (Martello and Toth). What is
left goes best-fit, longest first, for whole groups of equal sequences at a time. The plan is a bounded list of patterns, each with
a number of copies; pieces find their place by their rank among pieces of their length, so the assignment is one join of
bounded counts and one lookup per piece.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import text as tx
from assayer.llm.shared import stored

CAPACITY = 1024
END = 2
CACHE_BYTES = 24 << 20  # of the ids of text segments that a worker keeps from task to task
RANKED_ROWS = 1_000_000  # pieces of one length that one task ranks


# ---------------------------------------------------------------- tokens

_EXACT = tx._random(256, 23)
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)  # first bytes of characters that may be white space outside ASCII
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_NEXT = _PLAIN.copy()
_NEXT[0xC3:] = True
_NEXT &= ~_LEAD
_ODD = _LEAD.copy()
_ODD[:0x20] = True
_ODD[0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # an apostrophe may belong to the letters after it
_TWO = np.zeros(256, dtype=bool)  # second bytes of letters after 0xC3
_TWO[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Segments:
    """Token ids of texts, found segment by segment.

    The vocabulary's splitting pattern always begins a token at a single space or line feed between two characters that are
    not white space, and decides what follows from there on without looking back. So the text between two such places
    has the same ids wherever it stands, and each distinct segment is encoded once and then remembered. The same holds for a punctuation mark after an
    ASCII letter, if no special token has that mark. Beyond CACHE_BYTES the older half of the
    segments is forgotten. A special token's spelling inside a text is that token, as in the library. A space and letters
    are one part for the splitting pattern, so the library gets such segments without it, already in the vocabulary's alphabet of bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        self.pattern, self.bare = self.encoder.pre_tokenizer, None
        rules = json.loads(self.encoder.to_str())
        names = [x["content"] for x in rules["added_tokens"]]
        if rules["pre_tokenizer"] == _SPLIT and rules["normalizer"] is None and all(set(x) & set(_MARKS) for x in names):
            self.bare = pre_tokenizers.CharDelimiterSplit("\n")
            plain = [x for x in range(256) if 0x21 <= x < 0x7F or 0xA1 <= x and x != 0xAD]
            self.alphabet = np.arange(256, dtype="<u2")
            self.alphabet[np.setdiff1d(np.arange(256), plain)] = 0x100 + np.arange(256 - len(plain))
            self.led = np.zeros(max(self.encoder.get_vocab().values()) + 1, dtype=bool)
            self.led[[i for token, i in self.encoder.get_vocab().items() if token[0] == chr(self.alphabet[0x20])]] = True
            self.alphabet[0x0A] = 0x0A  # between segments
        special = "".join(names)
        self.marks = np.zeros(256, dtype=bool)
        self.marks[[ord(x) for x in _MARKS if x not in special]] = True
        self.kind = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        self.line = self.encoder.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted fingerprints
        self.place = np.zeros(0, dtype=np.int32)  # of each in ``begin``
        self.flat = np.zeros(1 << 20, dtype=self.kind)
        self.begin = np.zeros(1, dtype=np.int64)

    def shrink(self) -> None:
        """Forget the older half."""
        half = len(self.known) // 2
        first = int(self.begin[half])
        young = self.place >= half
        self.known, self.place = self.known[young], self.place[young] - half
        self.flat = self.flat[first : int(self.begin[-1])].copy()
        self.begin = self.begin[half:] - first

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(keys), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.place[at], -1).astype(np.int32)

    def _keep(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        used, n = int(self.begin[-1]), len(ids)
        if used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(n, len(self.flat)), dtype=self.kind)])
        self.flat[used : used + n] = ids
        place = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(keys), dtype=np.int32)
        self.begin = np.concatenate([self.begin, used + np.cumsum(length)])
        order = np.argsort(keys)
        at = np.searchsorted(self.known, keys[order])
        self.known, self.place = np.insert(self.known, at, keys[order]), np.insert(self.place, at, place[order])

    def _ids(self, texts: list[str], bare: bool = False) -> list[np.ndarray]:
        if bare:
            self.encoder.pre_tokenizer = self.bare
        try:
            return [np.array(x.ids, dtype=np.uint32) for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            if bare:
                self.encoder.pre_tokenizer = self.pattern

    def _learn(self, keys: np.ndarray, parts: list[bytes], odd: np.ndarray, word: np.ndarray) -> None:
        order, found, length, alone = [], [], [], [np.flatnonzero(odd)]
        group = np.flatnonzero(word)
        if len(group):
            joined = np.frombuffer(b"\n".join([parts[i] for i in group]), dtype=np.uint8)
            ids = self._ids([self.alphabet[joined].tobytes().decode("utf-16-le")], bare=True)[0]
            first = np.flatnonzero(self.led[ids])
            if len(first) == len(group):
                order.append(group), found.append(ids), length.append(np.diff(np.append(first, len(ids))))
            else:
                word = np.zeros(len(parts), dtype=bool)
        group = np.flatnonzero(~word & ~odd)
        if len(group):
            ids = self._ids([b"\n".join([parts[i] for i in group]).decode("utf-8", "replace")])[0]
            line = ids == self.line[0]
            cuts = np.flatnonzero(line)
            if len(self.line) == 1 and len(cuts) == len(group) - 1:
                order.append(group), found.append(ids[~line]), length.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:
                alone.append(group)
        rest = np.concatenate(alone)
        if len(rest):
            got = self._ids([parts[i].decode("utf-8", "replace") for i in rest])
            order.append(rest), found.extend(got), length.append(np.array([len(x) for x in got], dtype=np.int64))
        self._keep(keys[np.concatenate(order)], np.concatenate(found), np.concatenate(length))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 places where each text's ids begin."""
        out, counts = [], np.zeros(len(off) - 1, dtype=np.int64)
        at, n = 0, len(data)
        while at < n:
            cuts, at_next = self._cuts(data, off, at)
            ids, length = self._block(data, cuts, at_next)
            np.add.at(counts, np.searchsorted(off, cuts, "right") - 1, length)
            out.append(ids)
            at = at_next
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _cuts(self, data, off, at: int) -> tuple[np.ndarray, int]:
        """Where segments begin from ``at`` on, and where the block of segments ends."""
        n, limit = len(data), tx.BLOCK
        while True:
            to = min(n, at + limit)
            i = np.flatnonzero((data[at:to] == 0x20) | (data[at:to] == 0x0A)) + at
            i = i[(i > 0) & (i + 1 < n)]
            p = data[i - 1]
            far = (p >= 0x80) & ~_LEAD[data[np.maximum(i - 2, 0)]] & ~_LEAD[data[np.maximum(i - 3, 0)]]
            i = i[(_PLAIN[p] | far) & _NEXT[data[i + 1]]]
            first, last = np.searchsorted(off, at, "left"), np.searchsorted(off, to, "right")
            edges = off[first:last]
            i = i[~np.isin(i + 1, edges)]  # white space at the end of a text
            marks = np.flatnonzero(self.marks[data[at + 1 : to]] & _LETTER[data[at : to - 1]]) + at + 1
            cuts = np.sort(np.concatenate([i, i[data[i] == 0x0A] + 1, marks, edges, [at]]))
            cuts = cuts[(cuts >= at) & (cuts <= to) & (np.diff(cuts, prepend=-1) > 0)]
            if to == n:
                return cuts[cuts < n], n
            if len(cuts) > 1:
                return cuts[:-1], int(cuts[-1])
            limit *= 2

    def _block(self, data, cuts, to: int) -> tuple[np.ndarray, np.ndarray]:
        at = int(cuts[0])
        part = data[at:to]
        n = len(part)
        power, inverse = tx._powers(tx.BLOCK if n <= tx.BLOCK else 1 << (n - 1).bit_length())
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_EXACT[part] * power[:n], out=sums[1:])
        b = cuts - at
        e = np.append(b[1:], n)
        keys = tx.mix((sums[e] - sums[b]) * inverse[b])
        code, distinct = pd.factorize(keys)
        if 20 * len(self.known) + self.flat.itemsize * int(self.begin[-1]) > CACHE_BYTES:
            self.shrink()
        place = self._find(distinct)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            where = np.zeros(len(distinct), dtype=np.int64)
            where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            which = where[missing]
            odd = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(_ODD[part] | (part == 0x20), out=odd[1:])
            lead = (part[b[which]] == 0x20).astype(np.int64)
            strange = (odd[e[which]] - odd[b[which]] > lead) | (e[which] - b[which] <= lead)
            word = (lead == 1) & ~strange & (self.bare is not None)
            if word.any():
                letter = _LETTER[part]
                two = (part[:-1] == 0xC3) & _TWO[part[1:]]
                letter[:-1] |= two
                letter[1:] |= two
                np.cumsum(~letter, out=odd[1:])
                word &= (odd[e[which]] - odd[b[which]] == 1) & (part[e[which] - 1] != 0xC3)
            raw = part.tobytes()
            self._learn(distinct[missing], [raw[x:y] for x, y in zip(b[which].tolist(), e[which].tolist())], strange, word)
            place[missing] = self._find(distinct[missing])
        place = place[code]
        begin = self.begin[place]
        length = self.begin[place + 1] - begin
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids.astype(np.uint32), length


@functools.cache
def _segments(path: str) -> Segments:
    return Segments(path)


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's tokens followed by ``end``; with ``ids`` also the ids
    themselves. Only documents longer than ``capacity`` are cut; their first piece is the shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _segments(tokenizer)
        last = np.array([end], dtype="<u4")
        for batch in tx.portions(batches):
            flat, begin = encoder.encode(*tx.texts(batch.column("text")))
            flat = flat.astype("<u4", copy=False)
            row, number, start, length, crc, lists = [], [], [], [], [], []
            for i in range(len(batch)):
                own = np.concatenate([flat[begin[i] : begin[i + 1]], last])
                a, k = 0, 0
                b = len(own) % capacity or min(len(own), capacity)
                while a < len(own):
                    row.append(i), number.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(own[a:b].tobytes()))
                    if ids:
                        lists.append(own[a:b].astype(np.int32))
                    a, b, k = b, b + capacity, k + 1
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            columns = [doc, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        tx.release()

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tx.tidied(run), kind)


# ---------------------------------------------------------------- plan

Pattern = tuple[int, list[tuple[int, int]]]  # copies, runs of (length, how many)


def _smallest(left: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for s in np.flatnonzero(left[: len(left)])[:n]:
        out += [int(s)] * int(min(left[s], n))
        if len(out) >= n:
            break
    return out[:n]


def reduce_exactly(counts: np.ndarray) -> list[Pattern]:
    """Fix dominating sets and take them out of ``counts``, where ``counts[s]`` pieces have length s.

    For the longest piece w and the room r beside it, with k the longest other piece that fits r: {w} if nothing fits; {w, k} if k
    fills r, if no two pieces fit, or if at most two fit and k is as long as every two that fit; {w, k, b}, b the longest
    piece that fits beside k, if at most two fit and no two pieces longer than b fit. In each case any
    other set with w can be exchanged for the fixed one without needing another sequence.
    """
    capacity = len(counts) - 1
    fixed: list[Pattern] = []

    def fix(m: int, *lengths: int) -> None:
        runs: dict[int, int] = {}
        for s in lengths:
            runs[s] = runs.get(s, 0) + 1
        for s, n in runs.items():
            counts[s] -= m * n
        fixed.append((m, sorted(runs.items(), reverse=True)))

    for w in range(capacity, 0, -1):
        r = capacity - w
        if not counts[w]:
            continue
        if r == 0:
            fix(int(counts[w]), w)
        elif r == w:
            if counts[w] > 1:
                fix(int(counts[w] // 2), w, w)
        elif r < w and counts[r]:
            fix(int(min(counts[w], counts[r])), w, r)
    for w in range(capacity, 0, -1):
        r = capacity - w
        while counts[w]:
            counts[w] -= 1  # w itself is not beside w
            fits = np.flatnonzero(counts[: r + 1])
            few = _smallest(counts[: r + 1], 3)
            counts[w] += 1
            if not len(fits):
                fix(int(counts[w]), w)
                continue
            k = int(fits[-1])
            most = int(counts[w] // 2 if k == w else min(counts[w], counts[k]))
            if k == r or len(few) < 2 or few[0] + few[1] > r:
                fix(most, w, k)
                continue
            if len(few) == 3 and sum(few) <= r:
                break
            counts[w] -= 1
            best = 0
            longest = np.zeros(r + 1, dtype=np.int64)  # the longest piece up to each length
            longest[fits] = fits
            longest = np.maximum.accumulate(longest)
            for a in fits:
                b = int(longest[r - a])
                if b == a and counts[a] < 2:
                    b = int(longest[a - 1])
                best = max(best, int(a) + b if b else 0)
            counts[k] -= 1
            beside = np.flatnonzero(counts[: r - k + 1])
            counts[k] += 1
            b = int(beside[-1]) if len(beside) else 0
            longer = [int(s) for s in fits if s > b]
            two = _smallest(np.where(np.arange(r + 1) > b, counts[: r + 1], 0), 2) if longer else []
            counts[w] += 1
            spare = int(min(counts[x] for x in {w, k, b} if x)) // 3 - 3
            if k >= best:
                fix(max(1, min(spare, most)), w, k)
            elif b and (len(two) < 2 or sum(two) > r):
                fix(max(1, spare), w, k, b)
            else:
                break
    return fixed


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Longest first into the fullest sequence with room, for groups of equal sequences at a time."""
    capacity = len(counts) - 1
    groups: dict[int, list[Pattern]] = {}  # by room left
    for w in range(capacity, 0, -1):
        n = int(counts[w])
        while n:
            room = min((r for r in groups if r >= w), default=None)
            if room is None:
                copies, runs, room = n, [], capacity
            else:
                copies, runs = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            each = room // w
            full, rest = divmod(n, each)
            used = min(copies, full)
            if used:
                groups.setdefault(room - each * w, []).append((used, [*runs, (w, each)]))
                n -= used * each
            copies -= used
            if copies and 0 < n < each:
                groups.setdefault(room - n * w, []).append((1, [*runs, (w, n)]))
                copies, n = copies - 1, 0
            if copies and runs:
                groups.setdefault(room, []).append((copies, runs))
    return [p for group in groups.values() for p in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold exactly the pieces of ``histogram`` (length: number)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        counts[s] = n
    fixed = reduce_exactly(counts)
    return fixed + best_fit(counts)


def _slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in a run, offset), sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for copies, runs in patterns:
        at = 0
        for length, many in runs:
            first = taken.get(length, 0)
            rows.append((length, first, base, many, at))
            taken[length] = first + copies * many
            at += length * many
        base += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` tokens, filled from 0 without gaps.

    Reads ``doc_id`` and ``text`` of ``docs``; other columns are ignored. A null or empty text is one piece that holds only ``end``.
    Every row is a document of its own, also if ids repeat or are null. An empty table gives no rows. Only the counts per
    length (at most ``capacity`` rows) reach the driver.
    """
    cut = stored(pieces(docs, tokenizer, capacity=capacity, end=end, ids=ids), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    slots = _slots(plan(histogram, capacity))
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(slots)
    # as an Arrow table: rows of a list would start Python workers of another kind on every executor, which stay
    split = {"length": pa.array(histogram, pa.int64()), "shares": pa.array([-(-n // RANKED_ROWS) for n in histogram.values()], pa.int64())}
    shares = F.broadcast(spark.createDataFrame(pa.table(split)))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    own = F.pmod(F.xxhash64(*order), F.col("shares"))
    rows = cut.join(shares, "length").withColumn("share", own).drop("shares")
    counts = rows.groupBy("length", "share").count()
    before = "coalesce(sum(count) over (partition by length order by share rows between unbounded preceding and 1 preceding), 0)"
    offsets = F.broadcast(counts.selectExpr("length", "share", f"{before} as skipped"))  # capacity + pieces / RANKED_ROWS rows
    rank = F.expr(f"row_number() over (partition by length, share order by {', '.join(order)}) - 1")
    ranked = rows.withColumn("rank", rank).join(offsets, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("skipped")).drop("share", "skipped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = table.value
        key = slot[:, 0] * (1 << 50) + slot[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            got = slot[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1]
            copy, within = np.divmod(rank - got[:, 1], got[:, 3])
            kept = batch.drop_columns(["rank"])
            columns = [*kept.columns, pa.array(got[:, 2] + copy), pa.array(got[:, 4] + within * length)]
            yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(tx.tidied(run), kind)
