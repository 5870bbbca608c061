"""Global ordering and running sums without a single-task window.

Rows are cut into buckets that follow the sort order. Each bucket is windowed on its own; bucket
totals form a small table whose running sum is joined back as the offset of the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.selection import position, range_bounds, sortable
from assayer.session import task_count

HASH_BITS = 60


def hash_order(*parts: Column) -> Column:
    """A 60-bit number spread evenly by md5, the sort key of a seeded shuffle."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def hash_bucket(key: Column, buckets: int) -> Column:
    """Equal ranges of the hash space. Even by construction, whatever the data."""
    width = -(-(1 << HASH_BITS) // buckets)
    return F.floor(key / F.lit(width).cast("decimal(20,0)")).cast("int")


def range_bucket(df: DataFrame, order: str, buckets: int) -> tuple[DataFrame, int]:
    """Add ``bucket`` by value ranges of a numeric column that hold about equally many rows. The bounds are order statistics (at most
    ``buckets`` numbers on the driver); the result is exact with any bounds. ``df`` is read up to five times, so it should be a table."""
    bounds = range_bounds(df, order, buckets)
    return df.withColumn("bucket", position(bounds, sortable(F.col(order)))), len(bounds) + 1


def bucket_offsets(
    totals: DataFrame, by: list[str], sums: list[str], *, descending: bool = False
) -> DataFrame:
    """Running totals of the buckets before each bucket. One row per (by, bucket)."""
    order = F.col("bucket").desc() if descending else F.col("bucket")
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by,
        "bucket",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums],
    )


def running_sums(
    df: DataFrame, order: list[Column], sums: list[str], by: list[str] = (), *, descending=False
) -> DataFrame:
    """Add ``cum_<c>`` for each column over the order inside ``by``. ``df`` carries ``bucket``.

    Number of bucket rows = buckets x groups: with groups the offsets are merged, since they can be as many as the rows; without, Spark chooses how.
    """
    by = list(by)
    totals = df.groupBy(*by, "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = bucket_offsets(totals, by, sums, descending=descending)
    window = Window.partitionBy(*by, "bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = df.withColumns({f"__run_{c}": F.sum(c).over(window) for c in sums})
    joined = local.hint("merge").join(offsets, [*by, "bucket"]) if by else local.join(offsets, ["bucket"])
    out = joined.withColumns({f"cum_{c}": F.col(f"__run_{c}") + F.col(f"{c}_before") for c in sums})
    return out.drop(*[f"__run_{c}" for c in sums], *[f"{c}_before" for c in sums])


def global_order(
    df: DataFrame, key: str, tie: list[str], by: list[str] = (), buckets: int | None = None
) -> DataFrame:
    """Add ``ord`` = 0,1,2... in the order of a hash key, numbered inside ``by``.

    The key is a 60-bit hash, so hash ranges are even and need no sampling: a lost executor
    recomputes exactly the same buckets.
    """
    by = list(by)
    buckets = buckets or task_count(df.sparkSession)
    df = df.withColumn("bucket", hash_bucket(F.col(key), buckets))
    counts = df.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = bucket_offsets(counts, by, ["n"])
    local = Window.partitionBy(*by, "bucket").orderBy(key, *tie)
    return (
        df.withColumn("__pos", F.row_number().over(local))
        .join(F.broadcast(offsets) if not by else offsets, [*by, "bucket"])
        .withColumn("ord", (F.col("__pos") - 1 + F.col("n_before")).cast("long"))
        .drop("__pos", "n_before", "bucket")
    )
