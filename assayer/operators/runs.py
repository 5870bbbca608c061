"""Run logs: numeric metrics by name, the best step and the steps to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.tape import numeric_leaves


def scalar_metrics(log: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per number of a JSON log row, named by its path; objects may nest to any depth."""
    return log.select(*keys, F.inline(numeric_leaves(F.col(text))))


def best_step(rows: DataFrame, by: list[str], step: str, score: str) -> DataFrame:
    """The step with the lowest score in each run; the earliest on ties."""
    return rows.groupBy(*by).agg(
        F.min_by(F.struct(step, score), F.struct(score, step)).alias("b")
    ).select(*by, F.col(f"b.{step}").alias("best_step"), F.col(f"b.{score}").alias("best_score"))


def retained_steps(rows: DataFrame, by: list[str], step: str, score: str, keep: int) -> DataFrame:
    """The last ``keep`` steps of each run and its best one. The row-number limit is applied before
    the shuffle as well, so a long run sends at most ``keep`` rows per task."""
    window = Window.partitionBy(*by).orderBy(F.col(step).desc())
    last = rows.withColumn("__r", F.row_number().over(window)).filter(F.col("__r") <= keep)
    best = best_step(rows, by, step, score).select(*by, F.col("best_step").alias(step))
    return last.select(*by, step).unionByName(best).distinct()
