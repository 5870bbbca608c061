"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A document's features are the hashed one- and two-word grams of its words, and the one- to three-word grams of its words' shapes (runs
of lower-case letters, capitals, digits and each mark drawn together, so that ``Abc***`` is ``Aa*`` and repeated words are marked). Every feature has the
weight 1 + log(count), the vector has length 1. The model is a sparse vector of at most 2^BITS weights; a score is a sparse dot
product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import text as tx
from assayer.llm.shared import remainder

BITS = 18
SAMPLE = 6_000  # labelled documents at most that the model is fitted on, chosen by hash over all of them
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[x for x in range(128) if chr(x).islower()]] = ord("a")
_CLASS[[x for x in range(128) if chr(x).isupper()]] = ord("A")
_CLASS[[x for x in range(128) if chr(x).isdigit()]] = ord("0")
_CLASS[128:] = ord("a")
_SHAPE = tx._random(256, 31)[_CLASS]
_ORDER = tx._random(3, 37) | tx.U64(1)
_SAME = tx.U64(0x5851F42D4C957F2D)


def _grams(words: np.ndarray, rows: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    inside = rows[:n] == rows[size - 1 :]
    out = np.full(n, salt, dtype=np.uint64)
    for k in range(size):
        out += words[k : k + n] * _ORDER[k]
    return tx.mix(out[inside]), rows[:n][inside]


def _shapes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A fingerprint of each word's shape; another one if the word repeats the one before it."""
    kind = _CLASS[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[begin] = True
    # a polynomial in the number of runs so far, taken relative to the word's first run
    runs = np.cumsum(new)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    power, inverse = tx._powers(1 << max(20, int(len(data)).bit_length()))
    np.cumsum(np.where(new, _SHAPE[data] * power[runs - 1], tx.U64(0)), out=sums[1:])
    out = tx.mix((sums[end] - sums[begin]) * inverse[runs[begin] - 1])
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out[again] ^= _SAME
    return out


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text; none for a text without words."""
    data, off = tx.texts(column)
    n = len(off) - 1
    at = 0
    while at < n:  # texts of about a block at a time
        to = max(at + 1, int(np.searchsorted(off, off[at] + tx.BLOCK, "right")) - 1)
        part, own = data[off[at] : off[to]], off[at : to + 1] - off[at]
        words, rows, begin, end = tx.words(part, own, places=True)
        shapes = _shapes(part, begin, end, words, rows) if len(words) else words
        found = [_grams(words, rows, 1, 1), _grams(words, rows, 2, 2)] + [_grams(shapes, rows, k, 10 + k) for k in (1, 2, 3)]
        key = np.concatenate([f[0] for f in found]) >> tx.U64(64 - BITS)
        row = np.concatenate([f[1] for f in found])
        both = np.sort((row.astype(np.uint64) << tx.U64(BITS)) | key)
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(both)))
        number = (both[first] & tx.U64((1 << BITS) - 1)).astype(np.int64)
        cuts = np.searchsorted(both[first] >> tx.U64(BITS), np.arange(to - at + 1, dtype=np.uint64))
        value = 1 + np.log(count)
        for i in range(to - at):
            x = value[cuts[i] : cuts[i + 1]]
            yield number[cuts[i] : cuts[i + 1]], x / max(1e-12, float(np.sqrt((x * x).sum())))
        at = to


@dataclass
class Model:
    """Weights by feature number, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, number: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[number] @ value, -35, 35))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = EPOCHS) -> Model:
    """FTRL-Proximal, one update per document, the rows in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for number, value, label in rows:
            w = weight(z[number], n[number], L1)
            b = float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))
            p = 1 / (1 + np.exp(-np.clip(b + w @ value, -35, 35)))
            g = (p - label) * value
            step = (np.sqrt(n[number] + g * g) - np.sqrt(n[number])) / ALPHA
            z[number] += g - step * w
            n[number] += g * g
            d = p - label
            bias_z += d - (np.sqrt(bias_n + d * d) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += d * d
    return Model(weight(z, n, L1).astype(np.float32), float(weight(np.float64(bias_z), np.float64(bias_n), 0.0)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, *, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows that ``allowed`` marks, at most about ``sample`` of them. Without any, every score is 0.5.

    ``labels`` has ``doc_id`` and the 0/1 column ``label``. Null labels are left out; of repeated labels of a document each counts.
    The sampled documents' features are trained on in one task, in the order of a hash; it returns only the non-zero weights.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
    total = marked.count()
    order = F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(1 << 30))
    drawn = marked.where(order < min(1 << 30, int((1 << 30) * sample / max(1, total)))).withColumn("o", order)
    drawn = F.broadcast(drawn.limit(2 * sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(allowed).join(drawn, F.col("doc_id") == F.col("label_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.portions(batches):
            found = list(features(batch.column("text")))
            number = pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32()))
            value = pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("y"), number, value], ["o", "y", "number", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for y, number, value in zip(batch.column("y").to_pylist(), batch.column("number"), batch.column("value")):
                rows.append((np.array(number.values), np.array(value.values), y))
        model = train(rows)
        used = np.flatnonzero(model.weights)
        out = [pa.array(np.append(used, -1)), pa.array(np.append(model.weights[used].astype(float), model.bias))]
        yield pa.RecordBatch.from_arrays(out, ["number", "weight"])

    sparse = rows.select("o", "y", "text").mapInArrow(extract, "o long, y int, number array<int>, value array<float>")
    got = sparse.repartition(1).sortWithinPartitions("o", "y").mapInArrow(learn, "number long, weight double").toArrow()
    weights, bias = np.zeros(1 << BITS, dtype=np.float32), 0.0
    for number, weight in zip(got.column("number").to_pylist(), got.column("weight").to_pylist()):
        if number < 0:
            bias = weight
        else:
            weights[number] = weight
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score``: the probability of label 1 for the whole ``text``.

    A null or empty text, or one without words, has the score of the bias. Repeated rows each get a score; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in tx.portions(batches):
            found = [model.score(*f) for f in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind).select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "score")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2
