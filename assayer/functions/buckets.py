"""Binning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.constants import BINS, LENGTH_LIMITS


def length_bucket(n: Column) -> Column:
    """Name of the smallest limit that holds n tokens."""
    out = F.when(n <= LENGTH_LIMITS[0], str(LENGTH_LIMITS[0]))
    for limit in LENGTH_LIMITS[1:]:
        out = out.when(n <= limit, str(limit))
    return out.otherwise(f">{LENGTH_LIMITS[-1]}")


def probability_bin(p: Column, bins: int = BINS) -> Column:
    return F.least(F.lit(bins - 1), F.floor(p * bins).cast("int"))


def bit_length(n: Column) -> Column:
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)
