"""Metrics of a benchmark with gold distributions: one row per decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import BINS, BOOLEAN, KL_EPS, SCORE
from assayer.functions.buckets import probability_bin
from assayer.functions.scoring import mode_index
from assayer.operators.answers import expected_level
from assayer.operators.selection import median


def aligned_distribution(kind: Column, truth: Column, answer: Column, keys: Column) -> Column:
    """The answer as probabilities in the key order of the gold; a truth value becomes two."""
    two = F.transform(keys, lambda k: F.when(k == "true", truth).otherwise(1 - truth))
    return F.when(kind == BOOLEAN, two).otherwise(
        F.transform(keys, lambda k: F.element_at(answer, k))
    )


def answered(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold and predictions joined by (id, qid) with ``status``: ok, missing (no prediction), unexpected (no gold) or repeated."""
    count = lambda df, name: df.groupBy("id", "qid").agg(F.count(F.lit(1)).alias(name))
    both = count(gold, "asked").join(count(predictions, "given"), ["id", "qid"], "full")
    status = (
        F.when(F.col("given").isNull(), "missing").when(F.col("asked").isNull(), "unexpected")
        .when((F.col("given") > 1) | (F.col("asked") > 1), "repeated").otherwise("ok")
    )
    return both.select("id", "qid", status.alias("status")).join(gold, ["id", "qid"], "left").join(predictions, ["id", "qid"], "left")


def decision_metrics(df: DataFrame) -> DataFrame:
    """Per-decision columns from ``p``, ``g`` (gold probabilities), ``keys``, ``label``, ``type``."""
    p, g, keys = F.col("p"), F.col("g"), F.col("keys")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    floor = lambda x: F.greatest(x, F.lit(KL_EPS))
    df = df.withColumns({"pred": mode_index(p), "gold": F.array_position(keys, F.col("label")) - 1})
    gap = F.when(F.col("type") == SCORE, F.abs(expected_level(g) - expected_level(p)))
    return df.withColumns(
        {
            "hit": (F.col("pred") == F.col("gold")).cast("int"),
            "soft": F.get(g, F.col("pred")),
            "kl": total(F.zip_with(g, p, lambda b, a: b * F.log(floor(b) / floor(a)))),
            "tv": total(F.zip_with(p, g, lambda a, b: F.abs(a - b))) / 2,
            "brier": total(F.zip_with(p, g, lambda a, b: (a - b) * (a - b))),
            "top": F.array_max(p),
            "gap": gap,
            "predicted": F.get(keys, F.col("pred")),
        }
    )


def macro_f1(df: DataFrame) -> DataFrame:
    """Mean F1 over label names pooled across questions. Rows collapse to (predicted, gold) pairs
    before anything is exploded."""
    pairs = df.groupBy("predicted", "label").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("predicted") == F.col("label")
    sides = pairs.select(
        F.explode(
            F.when(
                same,
                F.array(F.struct(F.col("label").alias("name"), F.col("n").alias("tp"),
                                 F.lit(0).cast("long").alias("miss"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("label").alias("name"), F.lit(0).cast("long").alias("tp"),
                             F.col("n").alias("miss")),
                    F.struct(F.col("predicted").alias("name"), F.lit(0).cast("long").alias("tp"),
                             F.col("n").alias("miss")),
                )
            )
        ).alias("s")
    ).select("s.*")
    per_label = sides.groupBy("name").agg(F.sum("tp").alias("tp"), F.sum("miss").alias("miss"))
    return per_label.agg(
        F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("miss"))).alias("macro_f1"),
        F.count(F.lit(1)).alias("labels"),
    )


def benchmark_report(df: DataFrame) -> DataFrame:
    """One row: accuracy, soft accuracy, divergences, top-label calibration error, score gaps."""
    rows = decision_metrics(df)
    n = F.count(F.lit(1))
    per_bin = rows.groupBy(probability_bin(F.col("top"), BINS).alias("bin")).agg(
        n.alias("n"),
        *[F.sum(c).alias(c) for c in ("hit", "soft", "kl", "tv", "brier", "top", "gap")],
        F.count("gap").alias("scores"),
        F.sum((F.col("gap") <= 1.0).cast("int")).alias("within"),
    )
    total = F.sum("n")
    return per_bin.agg(
        total.alias("decisions"),
        (F.sum("hit") / total).alias("accuracy"),
        (F.sum("soft") / total).alias("soft_accuracy"),
        (F.sum("kl") / total).alias("kl_from_gold"),
        (F.sum("tv") / total).alias("tv"),
        (F.sum("brier") / total).alias("brier"),
        (F.sum(F.abs(F.col("hit") - F.col("top"))) / total).alias("ece_top_label"),
        F.try_divide(F.sum("gap"), F.sum("scores")).alias("score_mae"),
        F.try_divide(F.sum("within"), F.sum("scores")).alias("within_one_level"),
    )


def median_latency(df: DataFrame, column: str = "ms") -> DataFrame:
    """One row: the exact median, NULL without a value."""
    return median(df, column).agg(F.any_value("median").alias("ms_per_case_p50"))

