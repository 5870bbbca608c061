"""Equi-joins that split keys holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def fan_out_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    row_key: Column,
    *,
    count: str = "n",
    rows_per_task: int = ROWS_PER_TASK,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join many ``facts`` rows to one ``dim`` row per key, where ``dim[count]`` is the number of
    fact rows of that key.

    A key with more than ``rows_per_task`` rows is split over several salts and its dim row is
    copied once per salt. ``counts`` may give the key and ``count`` from before a costly step that made ``dim``. At most (rows / rows_per_task) keys can be that large, which bounds the
    broadcast table of hot keys; all other keys keep salt 0.
    """
    salts = F.ceil(F.col(count) / rows_per_task).cast("int")
    hot = (dim if counts is None else counts).filter(F.col(count) > rows_per_task).select(key, salts.alias("__salts"))
    spread = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = facts.join(F.broadcast(hot), key, "left").withColumn(
        "__salt",
        F.when(
            F.col("__salts").isNotNull(), F.pmod(F.xxhash64(row_key), F.col("__salts"))
        ).otherwise(0).cast("int"),
    )
    return salted.drop("__salts").join(spread, [key, "__salt"], how).drop("__salt")
