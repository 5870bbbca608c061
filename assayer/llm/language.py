"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of windows. For prediction every text is cut
into windows of ``WINDOW`` bytes, all of them are read in both directions, every byte gets a probability for each language, and a
document's probability is the mean over all its bytes. Both directions begin with a zero state at a window's edge.
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

WINDOW = 128  # bytes read at a stretch
HIDDEN = 8  # units of each direction
LANES = 1024  # windows that are read side by side
SAMPLE = 4096  # training documents at most, shared equally by the languages
SAMPLE_BYTES = 4096  # of each of them that can be drawn as training windows, from its middle
TRAIN_WINDOW = 48
STEPS, BATCH, RATE = 500, 256, 0.01
UNKNOWN = "und"


def squash(x: np.ndarray, work: np.ndarray) -> None:
    """x (27 + x^2) / (27 + 9 x^2) in place, for x clipped to -3..3: from -1 to 1 like tanh, at the cost of a few products."""
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=work)
    work += 27
    x *= work
    work *= 9
    work -= 216
    x /= work


def slope(x: np.ndarray) -> np.ndarray:
    """Derivative of ``squash``."""
    x = np.clip(x, -3, 3) ** 2
    return ((9 - x) / (9 + 3 * x)) ** 2


@dataclass
class Network:
    """Gates are ordered reset, update, candidate; the first two are (1 + squash) / 2.
    Every gate has an array of its own, so that whole arrays are processed at a stretch."""

    languages: list[str]
    table: np.ndarray  # 3 x 2 x 256 x H: each byte's part of the gates, with the bias
    inner: np.ndarray  # 3 x 2 x H x H
    head: np.ndarray  # 2H x L
    bias: np.ndarray  # L

    def states(self, windows: np.ndarray, width: np.ndarray, keep: bool = False):
        """States of both directions after every step, T x 2 x B x H. ``windows`` is B x T; the backward direction begins at the last of
        a window's ``width`` bytes."""
        lanes, span = windows.shape
        size = self.inner.shape[-1]
        reverse = np.maximum(width[:, None] - 1 - np.arange(span), 0)
        both = np.stack([windows, np.take_along_axis(windows, reverse, 1)]).astype(np.int64)
        index = np.ascontiguousarray((both + np.array([0, 256])[:, None, None]).transpose(2, 0, 1)).reshape(span, 2 * lanes)
        table = self.table.reshape(3, 512, size)
        out = np.empty((span, 2, lanes, size), dtype=self.table.dtype)
        h = np.zeros((2, lanes, size), dtype=self.table.dtype)
        gate = np.empty((3, 2 * lanes, size), dtype=self.table.dtype)
        gates = gate.reshape(3, 2, lanes, size)
        recurrent, work = np.empty_like(gates), np.empty_like(gates)
        saved = []
        for t in range(span):
            for k in range(3):
                np.take(table[k], index[t], axis=0, out=gate[k], mode="clip")
            np.matmul(h, self.inner, out=recurrent)
            both_gates = gates[:2]
            both_gates += recurrent[:2]
            before = gates[:2].copy() if keep else None
            squash(both_gates, work[:2])
            both_gates *= 0.5
            both_gates += 0.5
            reset, update, candidate = gates
            if keep:
                inside = recurrent[2].copy()
            recurrent[2] *= reset
            candidate += recurrent[2]
            if keep:
                saved.append((h, reset.copy(), update.copy(), candidate.copy(), inside, before))
            squash(candidate, work[2])
            now = out[t]
            np.subtract(h, candidate, out=now)
            now *= update
            now += candidate
            h = now
        return (out, saved, both) if keep else out

    def probabilities(self, windows: np.ndarray, width: np.ndarray) -> np.ndarray:
        """L x T x B: of each language at each byte; what stands beyond a window's width means nothing."""
        lanes, span = windows.shape
        out = self.states(windows, width)
        size = out.shape[-1]
        back = out[:, 1] @ self.head[size:]
        if (width == span).all():
            back = back[::-1]
        else:
            back = back[np.maximum(width[None, :] - 1 - np.arange(span)[:, None], 0), np.arange(lanes)[None, :]]
        score = out[:, 0] @ self.head[:size]
        score += back
        score += self.bias
        score = np.ascontiguousarray(np.moveaxis(score, -1, 0))
        np.clip(score, -40, 40, out=score)
        np.exp(score, out=score)
        score /= score.sum(axis=0)
        return score


def train(languages: list[str], windows: np.ndarray, labels: np.ndarray, *, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on the mean cross entropy over all bytes of random batches; the gradient runs back through the whole window."""
    rng = np.random.default_rng(seed)
    f4 = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    n = len(languages)
    net = Network(languages, f4(3, 2, 256, hidden), f4(3, 2, hidden, hidden), f4(2 * hidden, n), np.zeros(n, dtype=np.float32))
    weights = [net.table, net.inner, net.head, net.bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        grads = gradients(net, windows[pick], labels[pick])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(weights, grads, moments):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean loss by table, inner, head and bias."""
    out, saved, both = net.states(windows, np.full(len(windows), windows.shape[1]), keep=True)
    span, _, lanes, size = out.shape
    forward, backward = out[:, 0], out[::-1, 1]
    score = forward @ net.head[:size] + backward @ net.head[size:] + net.bias
    score = np.exp(score - score.max(axis=-1, keepdims=True))
    error = score / score.sum(axis=-1, keepdims=True)
    error[:, np.arange(lanes), labels] -= 1
    error /= span * lanes
    flat = error.reshape(-1, error.shape[-1])
    head = np.concatenate([forward.reshape(-1, size).T @ flat, backward.reshape(-1, size).T @ flat])
    above = np.stack([error @ net.head[:size].T, (error @ net.head[size:].T)[::-1]], axis=1)
    table, inner = np.zeros_like(net.table), np.zeros_like(net.inner)
    back = np.zeros((2, lanes, size), dtype=out.dtype)
    gates = np.empty((span, 3, 2, lanes, size), dtype=out.dtype)
    for t in range(span - 1, -1, -1):
        h, reset, update, candidate, recurrent, before = saved[t]
        back = back + above[t]
        d_candidate = back * (1 - update) * slope(candidate)
        squash(candidate, np.empty_like(candidate))
        d_update = back * (h - candidate) * 0.5 * slope(before[1])
        d_reset = d_candidate * recurrent * 0.5 * slope(before[0])
        gates[t] = d_reset, d_update, d_candidate
        inside = np.stack([d_reset, d_update, d_candidate * reset])
        inner += h.transpose(0, 2, 1) @ inside
        back = back * update + (inside @ net.inner.transpose(0, 1, 3, 2)).sum(axis=0)
    for k in range(2):
        index = both[k].T.ravel()
        for g in range(3):
            part = gates[:, g, k].reshape(-1, size)
            for i in range(size):
                table[g, k, :, i] = np.bincount(index, part[:, i], minlength=256)
    return [table, inner, head, flat.sum(axis=0)]


def fit(docs: DataFrame, allowed: Column, *, sample: int = SAMPLE, seed: int = 5) -> Network | None:
    """Train on at most ``sample`` documents of the rows that ``allowed`` marks, an equal share for each non-null ``lang``; a share is
    chosen by hash over all rows. None if there is nothing to learn from."""
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    share = max(1, sample // len(counts))
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1 << 30, int((1 << 30) * 0.9 * share / n) + (1 << 30) // max(1, n)))])
    middle = F.greatest(F.lit(1), ((F.length("text") - SAMPLE_BYTES) / 2).cast("int"))
    drawn = rows.where(order < bound[F.col("lang")]).select("lang", F.encode(F.substring("text", middle, F.lit(SAMPLE_BYTES)), "utf-8").alias("bytes"), order.alias("o"))
    got = drawn.limit(2 * sample).collect()
    got.sort(key=lambda r: (r.o, r.bytes))
    languages = sorted({r.lang for r in got})
    rng = np.random.default_rng(seed)
    windows, labels = [], []
    for r in got:
        data = np.frombuffer(bytes(r.bytes), dtype=np.uint8)
        data = np.tile(data, -(-TRAIN_WINDOW // len(data))) if len(data) < TRAIN_WINDOW else data
        for at in rng.integers(0, len(data) - TRAIN_WINDOW + 1, min(12, 1 + len(data) // TRAIN_WINDOW)):
            windows.append(data[at : at + TRAIN_WINDOW])
            labels.append(languages.index(r.lang))
    # equal weight for every language
    labels_ = np.array(labels)
    each = max(np.bincount(labels_, minlength=len(languages)))
    take = np.concatenate([np.resize(np.flatnonzero(labels_ == k), each) for k in range(len(languages))])
    return train(languages, np.array(windows)[take], labels_[take], seed=seed)


def pooled(net: Network, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean probabilities per text, n x L; zero for an empty text."""
    n = len(off) - 1
    out = np.zeros((n, len(net.languages)))
    lengths = np.diff(off)
    many = -(-lengths // WINDOW)
    row = np.repeat(np.arange(n), many)
    place = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    width = np.minimum(WINDOW, off[1:][row] - place)
    order = np.argsort(-width, kind="stable")
    for at in range(0, len(order), LANES):
        pick = order[at : at + LANES]
        span = np.arange(width[pick[0]])
        inside = span[None, :] < width[pick][:, None]
        windows = np.where(inside, data[np.minimum(place[pick][:, None] + span, len(data) - 1)], 0)
        found = net.probabilities(windows, width[pick])
        found *= inside.T
        for k, sums in enumerate(found.sum(axis=1, dtype=np.float64)):
            out[:, k] += np.bincount(row[pick], sums, minlength=n)
    return out / np.maximum(lengths, 1)[:, None]


def identify(docs: DataFrame, net: Network | None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` (string) and ``score`` (double, that language's pooled probability).

    Only ``text`` is read for the prediction. A null text, or one without a letter, is ``und`` with score 0, as is every text if
    there is no network. Ties go to the language that sorts first. Columns of those two names are replaced, others pass
    through. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    names = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]
    at = names.index("text") if "text" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        column = lambda b: b.column("text") if at is None else b.column("row").flatten()[at]
        for batch in tx.portions(batches, column):
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            data, off = tx.texts(column(batch))
            if net is None:
                score, lang = np.zeros(len(letter)), [UNKNOWN] * len(letter)
            else:
                found = pooled(net, data, off)
                score = np.where(letter, found.max(axis=1, initial=0), 0.0)
                lang = [net.languages[b] if k else UNKNOWN for b, k in zip(found.argmax(axis=1), letter)]
            columns = [batch.column("row"), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), letter, *(["text"] if at is None else []))
    kind = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tx.tidied(run), kind).select(*[F.col(f"row.`{c}`").alias(c) for c in names], "lang_pred", "score")
