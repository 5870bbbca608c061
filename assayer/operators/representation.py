"""Norms, spread and effective rank of a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import package_path

NORM_FLOOR = 1e-12


def moment_rows(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Sums of unit directions, one row per matrix row: first within each partition, then over partitions by row number.
    NULL and empty vectors take no part."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = total = None
        n, norm_sum = 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            norms = np.sqrt((x * x).sum(1))
            unit = x / np.maximum(norms, NORM_FLOOR)[:, None]
            gram = unit.T @ unit if gram is None else gram + unit.T @ unit
            total = unit.sum(0) if total is None else total + unit.sum(0)
            n, norm_sum = n + len(x), norm_sum + norms.sum()
        if gram is None:
            return
        d = len(total)
        data = np.zeros((d + 2, max(d, 2)))
        data[:d, :d], data[d, :d], data[d + 1, :2] = gram, total, (n, norm_sum)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 2), pa.int32()), pa.array(list(data), pa.list_(pa.float64()))], ["i", "v"]
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[i] = sums.get(i, 0) + np.array(v.values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x for x in sums.values()], pa.list_(pa.float64()))], ["i", "v"]
        )

    kind = "i int, v array<double>"
    parts = rows.where(F.size(vector) > 0).select(vector).mapInArrow(partial, kind)
    return parts.repartition("i").mapInArrow(summed, kind)


def representation_stats(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """count, mean_norm, direction_variance and effective_rank.

    Only the d x d moment matrix is brought together, never the vectors. Its eigenvalues are the
    squared singular values of the centred directions.
    """
    matrix = moment_rows(rows, vector).groupBy().agg(F.collect_list(F.struct("i", "v")).alias("m"))  # d + 2 rows

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries in batch.column(0).to_pylist():
                if not entries:
                    continue
                full = np.array([e["v"] for e in sorted(entries, key=lambda e: e["i"])])
                size = len(full) - 2
                n, norms = full[size + 1, 0], full[size + 1, 1]
                mean = full[size, :size] / n
                cov = full[:size, :size] / n - np.outer(mean, mean)
                energy = np.clip(np.linalg.eigvalsh(cov), 0, None)
                rank = 0.0
                if energy.sum() > 0:
                    q = energy / energy.sum()
                    q = q[q > 1e-15]
                    rank = float(np.exp(-(q * np.log(q)).sum()))
                yield pa.RecordBatch.from_pydict(
                    {"count": pa.array([int(n)], pa.int64()), "mean_norm": [norms / n],
                     "direction_variance": [float(np.trace(cov)) / size], "effective_rank": [rank]}
                )

    return matrix.mapInArrow(
        finish, "count long, mean_norm double, direction_variance double, effective_rank double"
    )


def _projected(rows: DataFrame, vector: str, base: np.ndarray | None, width: int) -> tuple[np.ndarray, int, float, np.ndarray]:
    """One pass over the unit directions u: the sum of u (u . Q) for the columns Q of ``base``, the number of vectors, the sum of |u|^2 and the sum of u. Every
    task sends d short rows, added up by row number."""
    shared = rows.sparkSession.sparkContext.broadcast(base)  # d x width, bounded by the caller's width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, data, n = shared.value, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            unit = x / np.maximum(np.sqrt((x * x).sum(1)), NORM_FLOOR)[:, None]
            now = np.zeros((unit.shape[1], width + 2))
            if q is not None:
                now[:, :width] = unit.T @ (unit @ q)
            now[:, width], now[:, width + 1] = unit.sum(0), (unit * unit).sum(0)
            data, n = now if data is None else data + now, n + len(unit)
        if data is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(data)), pa.int32()), pa.array([[float(n)], *data.tolist()], pa.list_(pa.float64()))], ["i", "v"])

    package_path(rows.sparkSession)
    parts = rows.where(F.size(vector) > 0).select(vector).mapInArrow(partial, "i int, v array<double>")
    sums = parts.select("i", F.posexplode("v").alias("k", "x")).groupBy("i", "k").agg(F.sum("x").alias("x")).collect()  # (width + 2) d numbers
    n = next((r.x for r in sums if r.i < 0), 0.0)
    out = np.zeros((1 + max((r.i for r in sums), default=-1), width + 2))
    for r in sums:
        if r.i >= 0:
            out[r.i, r.k] = r.x
    return out[:, :width], int(n), float(out[:, width + 1].sum()), out[:, width]


def wide_rank(rows: DataFrame, vector: str = "vector", *, width: int = 32, rounds: int = 8, seed: int = 0) -> dict:
    """count, energies (the ``width`` largest variances of the directions, by block power iteration from a random start), and effective_rank_low and _high.

    For vectors too wide for a d x d matrix in one place: each round is one pass that brings d rows of ``width`` numbers together. The variance that is not in
    the found directions is known exactly; were it one direction or spread evenly over the rest, the effective rank would be the low or the high bound. Both meet when the
    vectors lie in ``width`` dimensions.
    """
    _, n, energy, total = _projected(rows, vector, None, 0)
    d = len(total)
    if not n:
        return {"count": 0, "energies": [], "effective_rank_low": 0.0, "effective_rank_high": 0.0}
    width = min(width, d)
    mean = total / n
    whole = max(energy / n - float(mean @ mean), 0.0)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for _ in range(rounds):
        y = _projected(rows, vector, q, width)[0] / n - np.outer(mean, mean @ q)
        values = np.clip(np.linalg.eigvalsh((q.T @ y + (q.T @ y).T) / 2)[::-1], 0, None)
        q = np.linalg.qr(y)[0]

    def rank(parts: list[float]) -> float:
        p = np.array([x for x in parts if x > 1e-15 * max(whole, 1e-300)])
        p = p / p.sum() if len(p) else p
        return float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0

    rest = max(whole - float(values.sum()), 0.0)
    rest = rest if rest > 1e-9 * whole else 0.0
    spread = [rest / (d - width)] * (d - width) if d > width else []
    return {"count": n, "energies": values.tolist(), "effective_rank_low": rank([*values, rest]), "effective_rank_high": rank([*values, *spread])}
