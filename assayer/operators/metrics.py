"""Weighted summaries, calibration error, risk-coverage curves and slice reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import ALLOWED_SET
from assayer.functions.buckets import length_bucket, probability_bin
from assayer.functions.scoring import METRICS, allowed_vector, target_vector
from assayer.operators.prefix import range_bucket, running_sums
from assayer.session import stored, task_count

CURVE_POINTS = 11


def with_target_vectors(df: DataFrame) -> DataFrame:
    """Add ``t`` and ``allowed`` from the target columns of a decisions table."""
    allowed = F.col("allowed_keys") if "allowed_keys" in df.columns else F.lit(None).cast("array<string>")
    dist = F.col("dist") if "dist" in df.columns else F.lit(None).cast("array<double>")
    p_true = F.col("p_true") if "p_true" in df.columns else F.lit(None).cast("double")
    value = F.col("value") if "value" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "t": target_vector(F.col("keys"), F.col("kind"), p_true, value, dist),
            "allowed": allowed_vector(F.col("keys"), F.col("kind"), allowed),
        }
    )


def effective_weights(df: DataFrame, key: str = "id") -> DataFrame:
    """Record weight times question share, for a table of one row per supervised question.

    The totals are a partial aggregate; joining them back lets adaptive execution split a record
    that holds a large share of the rows, which a window over the record could not.
    """
    total = df.groupBy(key).agg(F.sum("question_weight").alias("__total"))
    return (
        df.join(total, key)
        .withColumn("weight", F.col("record_weight") * F.col("question_weight") / F.col("__total"))
        .drop("__total")
    )


def _metric_names(df: DataFrame) -> list[str]:
    return [m for m in (*METRICS, "zero_g_nll") if m in df.columns]


def binned(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Metric sums per (by, probability bin): the only pass over the rows. Map-side combine keeps
    at most bins x groups rows per task."""
    names = _metric_names(rows)
    w = F.col("weight")
    out = [
        F.count(F.lit(1)).alias("questions"),
        F.sum(w).alias("w"),
        F.sum(F.when(F.col("top_probability").isNotNull(), w)).alias("bin_w"),
    ]
    if "non_finite" in rows.columns:
        out.append(F.sum("non_finite").alias("non_finite_logits"))
    for m in names:
        out.append(F.sum(w * F.col(m)).alias(f"s_{m}"))
        out.append(F.sum(F.when(F.col(m).isNotNull(), w)).alias(f"w_{m}"))
    return rows.groupBy(*by, probability_bin(F.col("top_probability")).alias("bin")).agg(*out)


def summarize(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weighted mean of each metric over the rows that have it, expected calibration error, number
    of questions and total weight."""
    return summarize_bins(binned(rows, by), by)


def summarize_bins(bins: DataFrame, by: list[str] = ()) -> DataFrame:
    names = [c[2:] for c in bins.columns if c.startswith("s_")]
    gap = F.abs(F.col("s_top_probability") - F.col("s_accuracy"))
    out = [F.sum(f"s_{m}") / F.sum(f"w_{m}") for m in names]
    columns = [c.alias(m) for c, m in zip(out, names)]
    columns.append(
        (F.sum(F.when(F.col("bin").isNotNull(), gap)) / F.sum("bin_w")).alias("ece")
    )
    columns.append(F.sum("questions").alias("questions"))
    columns.append(F.sum("w").alias("effective_weight"))
    if "non_finite_logits" in bins.columns:
        columns.append(F.sum("non_finite_logits").alias("non_finite_logits"))
    return bins.groupBy(*by).agg(*columns)


def _soft(rows: DataFrame) -> DataFrame:
    """Rows with target probabilities. The filter names a stored column: a filter on a computed
    metric would be pushed below the scoring projections and copy them into itself."""
    return rows.filter(F.col("kind") != ALLOWED_SET) if "kind" in rows.columns else rows


def reliability_bins(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weight, mean probability and mean correctness of each non-empty bin."""
    w = F.col("weight")
    return (
        _soft(rows)
        .groupBy(*by, probability_bin(F.col("top_probability")).alias("bin"))
        .agg(
            F.sum(w).alias("weight"),
            (F.sum(w * F.col("top_probability")) / F.sum(w)).alias("probability"),
            (F.sum(w * F.col("accuracy")) / F.sum(w)).alias("correctness"),
        )
    )


def slice_labels(
    kind: Column, source: Column, state: Column, instruction: Column, longest: Column, k: Column,
    tags: Column | None = None,
) -> Column:
    """Labels of one question: primitive, source, three length buckets, outcome count, tags."""
    labels = F.array(
        F.lit("overall"),
        F.concat(F.lit("primitive:"), kind),
        F.concat(F.lit("source:"), source),
        F.concat(F.lit("S:"), length_bucket(state)),
        F.concat(F.lit("I:"), length_bucket(instruction)),
        F.concat(F.lit("T:"), length_bucket(longest)),
        F.concat(F.lit("K:"), k.cast("string")),
    )
    if tags is None:
        return labels
    return F.concat(labels, F.transform(tags, lambda x: F.concat(F.lit("slice:"), x)))


def slice_report(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """``summarize`` per label. Rows collapse by label combination before they are exploded."""
    combos = binned(rows, [labels]).withColumn("slice", F.explode(labels)).drop(labels)
    sums = [c for c in combos.columns if c not in ("slice", "bin")]
    merged = combos.groupBy("slice", "bin").agg(*[F.sum(c).alias(c) for c in sums])
    return summarize_bins(merged, ["slice"])


def risk_coverage(
    rows: DataFrame, by: list[str] = (), *, points: int = CURVE_POINTS, buckets: int | None = None
) -> DataFrame:
    """Risk and coverage when every question with at least the threshold score is accepted.

    Equal scores are one step. ``points`` steps are kept at positions round((n-1)*i/(points-1)),
    half to even. The steps are written once, so rows are scored once, and then cut into score ranges, so no task sees the whole curve.
    """
    by = list(by)
    spark = rows.sparkSession
    steps = _soft(rows).groupBy(*by, F.col("top_probability").alias("threshold")).agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * (1 - F.col("accuracy"))).alias("e"), F.lit(1).alias("one")
    )
    steps, _ = range_bucket(stored(steps, "curve-steps"), "threshold", buckets or task_count(spark))
    curve = running_sums(
        steps, [F.col("threshold").desc()], ["w", "e", "one"], by, descending=True
    )
    totals = steps.groupBy(*by).agg(F.sum("w").alias("total"), F.sum("one").alias("n"))
    wanted = totals.withColumn(
        "cum_one",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.lit(points - 1)),
                    lambda i: F.bround((F.col("n") - 1) * i / (points - 1)).cast("long") + 1,
                )
            )
        ),
    )
    return curve.join(F.broadcast(wanted) if not by else wanted, [*by, "cum_one"]).select(
        *by,
        "threshold",
        (F.col("cum_w") / F.col("total")).alias("coverage"),
        (F.col("cum_e") / F.col("cum_w")).alias("risk"),
    )


def slice_curves(rows: DataFrame, labels: str = "labels", **options) -> DataFrame:
    """Risk-coverage curve per label; rows collapse by (labels, score) before the explode."""
    combos = (
        _soft(rows)
        .groupBy(labels, "top_probability")
        .agg(
            F.sum("weight").alias("__w"),
            F.sum(F.col("weight") * F.col("accuracy")).alias("__a"),
        )
        .select(
            F.explode(labels).alias("slice"), "top_probability", F.col("__w").alias("weight"),
            (F.col("__a") / F.col("__w")).alias("accuracy"),
        )
    )
    return risk_coverage(combos, ["slice"], **options)


def decisions(questions: DataFrame, targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Supervised questions with their target and prediction, keyed by (id, qid). A question without
    a prediction stays, with NULL logits, which scoring refuses."""
    return questions.join(targets, ["id", "qid"]).join(predictions, ["id", "qid"], "left")
