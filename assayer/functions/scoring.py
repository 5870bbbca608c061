"""Proper scoring rules for one question per row.

Input columns: ``type``, ``kind``, ``logits`` ARRAY<DOUBLE> in outcome order, ``t`` ARRAY<DOUBLE>
(target probabilities, NULL for an allowed set), ``allowed`` ARRAY<DOUBLE> (0/1 per outcome) and
optionally ``temperature``. Each formula is written once and runs on lanes or arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import ALLOWED_SET, BERNOULLI, BOOLEAN, LOGIT_LIMIT, SCORE
from assayer.functions.vectors import Arrays, Lanes, saved_columns

METRICS = (
    "nll", "accuracy", "allowed_accuracy", "brier", "distribution_brier",
    "top_probability", "rps", "distribution_rps",
)

# Questions with at most this many outcomes are scored on lanes when no width is given.
LANE_LIMIT = 16


def infinite(x: Column) -> Column:
    return (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))


def not_finite(x: Column) -> Column:
    return F.isnan(x) | infinite(x)


def clean_logit(x: Column) -> Column:
    """NaN and -inf become the lowest usable logit, +inf the highest; NULL stays NULL."""
    return (
        F.when(F.isnan(x), -LOGIT_LIMIT)
        .when(x == F.lit(float("inf")), LOGIT_LIMIT)
        .when(x == F.lit(float("-inf")), -LOGIT_LIMIT)
        .otherwise(x)
    )


def target_vector(
    keys: Column, kind: Column, p_true: Column, value: Column, dist: Column
) -> Column:
    """Target probabilities in outcome order; NULL for an allowed set."""
    return (
        F.when(kind == BERNOULLI, F.array(p_true, 1 - p_true))
        .when(kind == ALLOWED_SET, F.lit(None).cast("array<double>"))
        .when(kind == "distribution", dist)
        .otherwise(F.transform(keys, lambda k: (k == value).cast("double")))
    )


def allowed_vector(keys: Column, kind: Column, allowed: Column) -> Column:
    mask = F.transform(keys, lambda k: F.array_contains(allowed, k).cast("double"))
    return F.when(kind == ALLOWED_SET, mask)


def binary_loss(x: Column, p_true: Column) -> Column:
    """Cross entropy of a truth logit against a probability, stable for large logits."""
    return F.greatest(x, F.lit(0.0)) - x * p_true + F.log1p(F.exp(-F.abs(x)))


def _score(df: DataFrame, make, keep_p: bool, prefix: str) -> DataFrame:
    temperature = F.col("temperature") if "temperature" in df.columns else F.lit(1.0)
    raw = make(F.col("logits"))
    bad = raw.map(lambda x: F.when(not_finite(x), 1.0).otherwise(0.0)).total() > 0
    df = df.withColumn("non_finite", bad.cast("int"))
    df, z = raw.map(lambda x: clean_logit(x) / temperature).save(df, "z")
    df, t = make(F.col("t")).save(df, "t")
    df, a = make(F.col("allowed")).save(df, "a")
    df = df.withColumn("__top", z.maximum())
    df, e = z.map(lambda x: F.exp(x - F.col("__top"))).save(df, "e")
    df = df.withColumn("__mass", e.total())
    df, p = e.map(lambda x: x / F.col("__mass")).save(df, "p")
    df = df.withColumns(
        {
            "__lse": F.col("__top") + F.log("__mass"),
            "chosen": e.first_at(F.lit(1.0)),
            "__ztop": z.zip(a, lambda x, on: F.when(on > 0, x)).maximum(),
        }
    )
    hit = z.zip(a, lambda x, on: F.when(on > 0, F.exp(x - F.col("__ztop"))).otherwise(0.0)).total()
    cross = t.zip(z, lambda q, x: q * (F.col("__lse") - x)).total()
    boolean = binary_loss(z.at(F.lit(0)) - z.at(F.lit(1)), t.at(F.lit(0)))
    loss = (
        F.when(F.col("kind") == ALLOWED_SET, F.col("__lse") - F.col("__ztop") - F.log(hit))
        .when(F.col("type") == BOOLEAN, boolean)
        .otherwise(cross)
    )
    loss = F.when(
        not_finite(loss), F.raise_error("scaled logits exceed the finite double range")
    ).otherwise(loss)
    soft = F.col("kind") != ALLOWED_SET
    columns = {
        "nll": loss,
        "accuracy": F.when(soft, t.at(F.col("chosen"))),
        "allowed_accuracy": F.when(~soft, a.at(F.col("chosen"))),
        "brier": F.when(
            soft, p.map(lambda x: x * x).total() - 2 * p.zip(t, lambda x, q: x * q).total() + 1
        ),
        "distribution_brier": F.when(soft, p.zip(t, lambda x, q: (x - q) * (x - q)).total()),
        # The largest e is exactly one, so the largest probability is one over the mass.
        "top_probability": F.when(soft, 1 / F.col("__mass")),
    }
    fp, ft = p.prefix(), t.prefix()
    levels = F.greatest(F.size("logits") - 1, F.lit(1)).cast("double")
    ordinal = soft & (F.col("type") == SCORE)
    columns["rps"] = F.when(
        ordinal, fp.zip(ft, lambda x, q: x * x - 2 * x * q + q).total() / levels
    )
    columns["distribution_rps"] = F.when(
        ordinal, fp.zip(ft, lambda x, q: (x - q) * (x - q)).total() / levels
    )
    if keep_p:
        columns["p"] = p.array()
    df = df.withColumns({prefix + k if k != "p" else k: v for k, v in columns.items()})
    return df.drop(*saved_columns(df))


def score(
    df: DataFrame, width: int | None = None, *, keep_p: bool = False, prefix: str = ""
) -> DataFrame:
    """Add the metric columns of ``METRICS``, ``chosen`` and ``non_finite``.

    A row without logits, or whose logits, outcomes and target differ in length, is an error.
    ``width`` states the largest number of outcomes in the table; a longer row is an error. Without
    it, rows up to ``LANE_LIMIT`` outcomes run on lanes and longer rows on arrays.
    """
    n = F.size("logits")
    lost = F.col("logits").isNull() | (n == 0)
    uneven = (F.size("t") != n) | (F.size("allowed") != n)  # NULL where there is no such target
    if "keys" in df.columns:
        uneven = F.coalesce(uneven, F.lit(False)) | (F.size("keys") != n)
    checked = F.when(lost, F.raise_error("a question without logits")).when(
        uneven, F.raise_error("logits, outcomes and target differ in length")
    )
    if width is not None:
        checked = checked.when(n > width, F.raise_error(f"more than {width} outcomes in a row"))
        df = df.withColumn("logits", checked.otherwise(F.col("logits")))
        return _score(df, lambda c: Lanes.of(c, width), keep_p, prefix)
    df = df.withColumn("logits", checked.otherwise(F.col("logits")))
    short = F.size("logits") <= LANE_LIMIT  # never NULL: a row without logits has failed
    return _score(
        df.filter(short), lambda c: Lanes.of(c, LANE_LIMIT), keep_p, prefix
    ).unionByName(_score(df.filter(~short), Arrays, keep_p, prefix))


def score_arrays(df: DataFrame, *, keep_p: bool = False) -> DataFrame:
    """The array form for every row; the test suite holds both forms against each other."""
    return _score(df, Arrays, keep_p, "")


def probabilities(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax that stays finite for every positive temperature: scale first when it is at least
    one, shift first below one. A gap that overflows to -inf has probability zero."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    top = F.array_max(logits)
    gaps = F.transform(
        logits, lambda x: F.when(t >= 1, x / t - top / t).otherwise((x - top) / t)
    )
    e = F.transform(gaps, F.exp)
    mass = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / mass)


def mode_index(p: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
