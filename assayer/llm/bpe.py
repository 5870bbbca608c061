"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are split into pieces by the vocabulary's fixed splitting rule (letters, digits, other marks, each with one leading space; contractions; white space). The
distinct pieces of a chunk of a partition become one linked array of symbols. An index maps every pair of neighbouring symbols that
has a rank to all its positions. Active ranks are applied in ascending order: all positions of a pair are merged at once, and the
pairs that appear beside the merged symbols join the lists of their ranks. A merge only makes pairs of later ranks (checked when the file
is read), so this gives each piece what merging its pairs one by one gives.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import text as tx

CHUNK = 4 << 20  # bytes of text whose pieces share one pair index
SLICE = 1 << 18  # ids turned into bytes at once
WHITE, LETTER, DIGIT, OTHER, UNSEEN = range(5)
_INK = np.zeros(256, dtype=bool)  # ASCII that is neither white space nor a control character
_INK[0x21:0x7F] = True


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices begin[i], ..., begin[i] + length[i] - 1, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizers file. Files with other settings are an error."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or file["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in odd):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        names = byte_names()
        value = {c: b for b, c in enumerate(names)}
        vocab = model["vocab"]
        self.special = {}
        for token in file["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or re.search(r"\s", token["content"]):
                raise ValueError(f"added token {token['content']!r} is more than a plain string")
            self.special[token["content"].encode()] = token["id"]
        spelled = {i: bytes(value[c] for c in name) for name, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = max(spelled) + 1
        self.byte_id = np.array([vocab[c] for c in names], dtype=np.int32)
        self.spelling = _Strings([spelled.get(i, b"") for i in range(self.size)])
        self.decimal = _Strings([b"%d," % i for i in range(self.size)])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right = (np.array([vocab[p[side]] for p in pairs], dtype=np.int64) for side in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = self.left * self.size + self.right
        self.rank_order = np.argsort(key)
        self.keys = key[self.rank_order]
        first = np.full(self.size, -1)
        first[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or len(np.unique(key)) < len(pairs) or (np.maximum(first[self.left], first[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} has merges out of order")
        self.classes = np.full(0x110000, UNSEEN, dtype=np.uint8)
        self._see(np.arange(128))

    # ---- pieces

    def _see(self, points: np.ndarray) -> None:
        """Class of code points that were not seen before, as the library's own splitter has it (its Unicode version counts)."""
        for p in points.tolist():
            beside = [len(self.splitter.pre_tokenize_str(mark + chr(p))) == 1 for mark in "a1."]
            self.classes[p] = next((k for k, same in zip((LETTER, DIGIT, OTHER), beside) if same), WHITE)

    def _points(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the characters of UTF-8 bytes begin, and their code points."""
        at = np.flatnonzero((part & 0xC0) != 0x80)
        first = part[at].astype(np.int32)
        points = first.copy()
        padded = np.append(part, np.zeros(3, np.uint8)).astype(np.int32)
        for low, high, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
            where = np.flatnonzero((first >= low) & (first < high))
            if len(where):
                value = first[where] & bits
                for k in range(1, size):
                    value = value << 6 | padded[at[where] + k] & 0x3F
                points[where] = value
        return at, points

    def starts(self, part: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pieces begin in a block of whole characters; at ``edges`` a text or a special token begins or ends."""
        at, points = self._points(part)
        kind = self.classes[points]
        unseen = points[kind == UNSEEN]
        if len(unseen):
            self._see(np.unique(unseen))
            kind = self.classes[points]
        n = len(at)
        hard = np.zeros(n + 4, dtype=bool)
        hard[np.searchsorted(at, edges)] = True
        hard[0] = hard[n:] = True
        white, space = kind == WHITE, points == 0x20
        before, last = np.append(OTHER, kind[:-1]), np.append(False, space[:-1])
        again = white & ~hard[1 : n + 1] & ~np.append(white[1:], True)  # white space just before something else
        begins = np.where(white, (before != WHITE) | again, (before != kind) & ~last)
        begins = np.append(begins | hard[:n], np.ones(4, dtype=bool))
        quote = np.flatnonzero((points == 0x27) & begins[:n] & ~hard[1 : n + 1])
        if len(quote):
            ahead = np.append(points, np.zeros(3, points.dtype))
            one, two = ahead[quote + 1], ahead[quote + 2]
            for size, fits in ((2, np.isin(one, [ord(c) for c in "stmd"])), (3, self._ends(one, two) & ~hard[quote + 2])):
                begins[quote[fits] + 1] = False
                begins[quote[fits] + size] = True
        return at[np.flatnonzero(begins[:n])]

    @staticmethod
    def _ends(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return functools.reduce(np.logical_or, [(one == ord(x)) & (two == ord(y)) for x, y in ("re", "ve", "ll")])

    def _blocks(self, data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about BLOCK bytes that end at an edge, or before a single space between two printed ASCII characters: a piece always begins there."""
        at, n = 0, len(data)
        while at < n:
            size = tx.BLOCK
            while True:
                to = min(n, at + size)
                if to == n:
                    break
                i = np.arange(at + 1, to)
                i = i[(data[at + 1 : to] == 0x20)]
                i = i[_INK[data[i - 1]] & _INK[data[i + 1]]]
                edge = int(edges[np.searchsorted(edges, to, "right") - 1])
                cut = max(int(i[-1]) if len(i) else 0, edge)
                if cut > at:
                    to = cut
                    break
                size *= 2
            yield at, to
            at = to

    def _special_spans(self, raw: bytes, off: np.ndarray) -> list[tuple[int, int]]:
        if not any(s in raw for s in self.special):
            return []
        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        return [(a + m.start(), a + m.end()) for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in pattern.finditer(raw[a:b])]

    # ---- merges

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left * np.int64(self.size) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_order[at], -1)

    def merge(self, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as bytes ``flat`` and their n + 1 bounds: all ids, and the bounds of each piece's ids."""
        n = len(flat)
        symbol = np.append(self.byte_id[flat], -1)  # place n stands for the end of every piece
        following = np.append(np.arange(1, n + 1), n)
        following[begin[1:] - 1] = n
        previous = np.append(np.arange(-1, n - 1), n)
        previous[begin[:-1]] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """The pairs that begin at these positions go to the lists of their ranks."""
            rank = self.ranks(symbol[at], symbol[following[at]])
            known = rank >= 0
            rank, at = rank[known], at[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, x, y in zip(rank[bounds[:-1]].tolist(), bounds[:-1], bounds[1:]):
                if r in index:
                    index[r].append(at[x:y])
                else:
                    index[r] = [at[x:y]]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(following[:n] < n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, c = int(self.left[r]), int(self.right[r]), int(self.made[r])
            at = at[(symbol[at] == a) & (symbol[following[at]] == b)]
            if a == b and len(at) > 1:  # of a run of equal symbols every second pair, from the left
                at = np.sort(at)
                number = np.arange(len(at))
                opens = np.append(True, following[at[:-1]] != at[1:])
                at = at[(number - np.maximum.accumulate(np.where(opens, number, 0))) % 2 == 0]
            if not len(at):
                continue
            taken = following[at]
            after = following[taken]
            symbol[at], symbol[taken] = c, -1
            following[at] = after
            previous[after] = at
            before = previous[at]
            enter(np.concatenate([at[after < n], before[(before < n) & (symbol[before] != c)]]))
        alive = symbol[:n] >= 0
        bounds = np.append(0, np.cumsum(alive))[begin]
        return symbol[:n][alive], bounds

    # ---- texts

    def _chunk(self, data: np.ndarray, begins: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at ``begins`` and fill data up to ``to``, and how many each has."""
        at = int(begins[0])
        part = data[at:to]
        b = begins - at
        length = np.diff(np.append(b, len(part)))
        code, distinct = pd.factorize(_fingerprints(part, b))
        first = np.zeros(len(distinct), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        # equal fingerprints count only if the bytes are equal
        same = length == length[first[code]]
        step = max(1, tx.BLOCK // 8)
        for x in range(0, len(code), step):
            y = min(len(code), x + step)
            own = np.flatnonzero(same[x:y]) + x
            ends = np.cumsum(length[own])
            equal = part[_ranges(b[own], length[own])] == part[_ranges(b[first[code[own]]], length[own])]
            if not equal.all():
                wrong = np.searchsorted(ends, np.flatnonzero(~equal), "right")
                same[own[wrong]] = False
        alone = np.flatnonzero(~same)
        code[alone] = len(first) + np.arange(len(alone))
        first = np.append(first, alone)
        size = length[first]
        flat = part[_ranges(b[first], size)]
        ids, bounds = self.merge(flat, np.append(0, np.cumsum(size)))
        begin, count = bounds[:-1], np.diff(bounds)
        raw = part.tobytes()
        for spelling, token in self.special.items():
            if spelling in raw:
                for k in np.flatnonzero(size == len(spelling)).tolist():
                    x = int(b[first[k]])
                    if raw[x : x + len(spelling)] == spelling:
                        begin[k], count[k] = len(ids), 1
                        ids = np.append(ids, np.int32(token))
        return ids[_ranges(begin[code], count[code])].astype(np.int32), count[code]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 places where each text's ids begin."""
        spans = np.array(self._special_spans(data.tobytes() if self.special else b"", off), dtype=np.int64).reshape(-1, 2)
        edges = np.unique(np.concatenate([off, spans.ravel()]))
        counts, out = np.zeros(len(off) - 1, dtype=np.int64), []
        waiting: list[np.ndarray] = []
        opened = 0
        for at, to in self._blocks(data, edges):
            inner = edges[np.searchsorted(edges, at) : np.searchsorted(edges, to)] - at
            begins = self.starts(data[at:to], inner) + at
            if len(spans):
                inside = np.searchsorted(spans[:, 0], begins, "left") - 1
                begins = begins[(inside < 0) | (begins >= spans[np.maximum(inside, 0), 1])]
            waiting.append(begins)
            if to - opened >= CHUNK or to == len(data):
                begins = np.concatenate(waiting)
                ids, many = self._chunk(data, begins, to)
                counts += np.bincount(np.searchsorted(off, begins, "right") - 1, many, len(counts)).astype(np.int64)
                out.append(ids)
                waiting, opened = [], to
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.append(0, np.cumsum(counts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for. An id outside the vocabulary stands for nothing."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        return b"".join(self.spelling.joined(ids[k : k + SLICE]) for k in range(0, len(ids), SLICE))


class _Strings:
    """Byte strings by number, joined for whole arrays of numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.length = np.array([len(s) for s in strings], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def joined(self, numbers: np.ndarray) -> bytes:
        return self.flat[_ranges(self.begin[numbers], self.length[numbers])].tobytes()


_EXACT = tx._random(256, 23)


def _fingerprints(part: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit value per piece. Equal bytes give equal values."""
    out = np.zeros(len(b), dtype=np.uint64)
    for x, y, k, j in _spans(b, len(part)):
        power, inverse = tx._powers(tx.BLOCK if y - x <= tx.BLOCK else 1 << (y - x - 1).bit_length())
        sums = np.zeros(y - x + 1, dtype=np.uint64)
        np.cumsum(_EXACT[part[x:y]] * power[: y - x], out=sums[1:])
        begin = b[k:j] - x
        out[k:j] = tx.mix((sums[np.append(begin[1:], y - x)] - sums[begin]) * inverse[begin])
    return out


def _spans(b: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges of at most BLOCK bytes, or one piece, that begin and end with a piece, and their pieces."""
    k = 0
    while k < len(b):
        j = max(k + 1, int(np.searchsorted(b, b[k] + tx.BLOCK, "right")) - 1)
        if n - b[k] <= tx.BLOCK:
            j = len(b)
        yield int(b[k]), int(b[j]) if j < len(b) else n, k, j
        k = j


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, as the tokenizers library gives them without special tokens added, truncation or padding.

    ``path`` names a vocabulary file that lies at the same place on every executor. A special token's spelling inside a text is that token, as in the
    library. A null or empty text has no ids. Each row gives one row, also if ids are null or repeat; other columns are ignored. An
    empty table gives no rows. Work arrays cover CHUNK bytes; a row's ids are one value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in tx.portions(batches, limit=CHUNK):
            ids, begin = words.encode(*tx.texts(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text``: the text that each row's ``ids`` stand for, special tokens included. Null or empty ids give an empty text, bytes
    that are no UTF-8 the replacement character, ids outside the vocabulary nothing. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                values = ids.values
                numbers = np.zeros(0, np.int32) if values is None else values.drop_null().to_numpy(zero_copy_only=False)
                out.append(words.decode(numbers).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.string())], ["doc_id", "ids", "text"])
        tx.release()

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of decoded rows; ids are written in decimal and joined by commas."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return decoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
