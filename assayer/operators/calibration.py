"""Temperature fitting: one aggregate over the whole logits table per Newton step."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.constants import ALLOWED_SET
from assayer.functions.vectors import Arrays, Lanes

MAX_STEPS = 60
STEP_LIMIT = 2.0
TOLERANCE = 1e-9


def calibration_rows(df: DataFrame, *, by_count: bool = False) -> DataFrame:
    """Complete targets with more than one outcome, reduced to (key, logits, t, weight)."""
    key = F.col("type")
    if by_count:
        key = F.concat_ws(":", "type", F.size("keys").cast("string"))
    return df.filter((F.col("kind") != ALLOWED_SET) & (F.size("keys") > 1)).select(
        key.alias("key"), "logits", "t", "weight"
    )


def _pass(rows: DataFrame, beta: dict[str, float], width: int | None) -> dict[str, tuple]:
    """Weighted loss, slope and curvature in the inverse temperature, for every key at once."""
    pairs = [F.lit(x) for item in beta.items() for x in item]
    df = rows.withColumn("__beta", F.element_at(F.create_map(*pairs), F.col("key")))
    make = (lambda c: Lanes.of(c, width)) if width else Arrays
    df, z = make(F.col("logits")).save(df, "z")
    df, t = make(F.col("t")).save(df, "t")
    df = df.withColumn("__top", z.maximum() * F.col("__beta"))
    df, e = z.map(lambda x: F.exp(x * F.col("__beta") - F.col("__top"))).save(df, "e")
    df = df.withColumns(
        {
            "__mass": e.total(),
            "__ez": e.zip(z, lambda a, x: a * x).total(),
            "__ezz": e.zip(z, lambda a, x: a * x * x).total(),
            "__tz": t.zip(z, lambda q, x: q * x).total(),
            "__tt": t.total(),
        }
    )
    w, tt = F.col("weight"), F.col("__tt")
    mean = F.col("__ez") / F.col("__mass")
    loss = tt * (F.col("__top") + F.log("__mass")) - F.col("__beta") * F.col("__tz")
    slope = tt * mean - F.col("__tz")
    curve = tt * (F.col("__ezz") / F.col("__mass") - mean * mean)
    out = df.groupBy("key").agg(
        F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"),
        *[(F.sum(w * c) / F.sum(w)).alias(a) for c, a in ((loss, "f"), (slope, "g"), (curve, "h"))],
    )
    return {r["key"]: (r["f"], r["g"], r["h"], r["n"]) for r in out.collect()}


def fit_temperatures(df: DataFrame, *, by_count: bool = False, width: int | None = None) -> DataFrame:
    """Temperature per question type (or type and outcome count) minimising the weighted loss.

    Newton in 1/T, bounded in log T, with a sign bracket: the loss is convex in 1/T, so the slope's sign always tells
    the side of the minimum. A key whose fit does not improve on 1 keeps 1. Only a few numbers per
    key reach the driver.
    """
    rows = calibration_rows(df, by_count=by_count).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        keys = [r["key"] for r in rows.select("key").distinct().collect()]
        if not keys:
            raise ValueError("no complete probability targets available for calibration")
        u = dict.fromkeys(keys, 0.0)
        low, high = dict.fromkeys(keys, -math.inf), dict.fromkeys(keys, math.inf)
        first, last, open_keys = None, {}, set(keys)
        for _ in range(MAX_STEPS):
            state = _pass(rows, {k: math.exp(-u[k]) for k in keys}, width)
            first = first or state
            for k in keys:
                last[k] = (u[k], state[k][0])
            for k in sorted(open_keys):
                _f, g, h, _n = state[k]
                beta = math.exp(-u[k])
                slope = -beta * g
                if abs(slope) < TOLERANCE:
                    open_keys.discard(k)
                    continue
                if slope > 0:
                    high[k] = u[k]
                else:
                    low[k] = u[k]
                # The loss is close to quadratic in 1/T: step there, move in log T.
                target = beta - g / h if h > 0 else 0.0
                step = -math.log(target / beta) if target > 0 else -math.copysign(STEP_LIMIT, slope)
                new = u[k] + max(-STEP_LIMIT, min(STEP_LIMIT, step))
                if not low[k] < new < high[k]:
                    new = (low[k] + high[k]) / 2
                if abs(new - u[k]) < TOLERANCE:
                    open_keys.discard(k)
                u[k] = new
            if not open_keys:
                break
        if open_keys:
            raise ValueError(f"no minimum found within {MAX_STEPS} steps for {sorted(open_keys)}")
        result = []
        for k in sorted(keys):
            before, (where, after) = first[k][0], last[k]
            better = after <= before
            result.append(
                (k, math.exp(where) if better else 1.0, int(first[k][3]), before,
                 after if better else before)
            )
        return df.sparkSession.createDataFrame(
            result, "key string, temperature double, questions long, nll_before double, nll_after double"
        )
    finally:
        rows.unpersist()


def calibration_groups(records: DataFrame) -> DataFrame:
    """The distinct split groups a calibration used, as a table rather than a list."""
    return records.select("split_group").distinct()


def write_calibration(fit: DataFrame, records: DataFrame, model_sha256: str, path: str) -> None:
    """The fit bound to its model, and beside it the split groups it used: what ``read_temperatures`` and ``independence`` expect."""
    calibration_groups(records).write.mode("overwrite").parquet(f"{path}/groups")
    fit.withColumn("model_sha256", F.lit(model_sha256)).write.mode("overwrite").parquet(f"{path}/temperatures")
