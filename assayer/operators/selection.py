"""Exact order statistics of doubles without a sort or a sketch.

A double's bits, with those below the sign flipped for negative numbers, are a 64-bit integer of the same order. Selection refines it radix by
radix: a histogram over the next ``DIGIT`` bits, counted map-side, tells in which cell the wanted rank lies, and only the values of that cell are
counted again. After four rounds at most the cell is one value. A histogram has at most 2^16 rows per wanted cell, whatever the
table; no task sees a group as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import stored

BITS, DIGIT = 64, 16
_LOW = (1 << 63) - 1


def sortable(value: Column) -> Column:
    """A long that orders like the double: -0.0 and 0.0 are one value, NaN comes last, NULL stays NULL."""
    plain = F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOW))).otherwise(bits))


def double_of(key: Column) -> Column:
    """The double of a sortable long."""
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(_LOW))).otherwise(key)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _refine(keys: DataFrame, wanted: DataFrame, by: list[str], shift: int) -> DataFrame:
    """One radix: ``wanted`` (by, prefix, rank, wish) with the prefix that is ``DIGIT`` bits longer and the rank inside its cell, and the cell's ``size``."""
    above = F.shiftright("key", shift + DIGIT) if shift + DIGIT < BITS else F.lit(0).cast("long")
    cells = wanted.select(*by, "prefix").distinct()
    counted = (
        keys.select(*by, above.alias("prefix"), F.shiftright("key", shift).alias("cell"))
        .join(cells, [*by, "prefix"]).groupBy(*by, "prefix", "cell").agg(F.count(F.lit(1)).alias("size"))
    )
    upto = F.sum("size").over(Window.partitionBy(*by, "prefix").orderBy("cell"))
    found = wanted.join(counted.withColumn("upto", upto), [*by, "prefix"])
    found = found.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("size") < F.col("rank")))
    return found.select(*by, F.col("cell").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("size")).alias("rank"), "wish", "size")


def order_statistics(rows: DataFrame, column: str, wishes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, wish, value): the ``wish``-th smallest value of each group, counted from 1, for the rows (by, wish) of ``wishes``.

    NULLs do not count; a wish beyond the group's size gives no row. The keys are written once to the shared folder, each round reads only their column.
    """
    by = list(by)
    keys = stored(rows.where(F.col(column).isNotNull()).select(*by, sortable(F.col(column)).alias("key")), "selection-keys")
    wanted = wishes.select(*by, F.lit(0).cast("long").alias("prefix"), F.col("wish").cast("long").alias("rank"), F.col("wish").cast("long").alias("wish")).distinct()
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        wanted = stored(_refine(keys, wanted, by, shift).drop("size"), "selection-cells")
    return wanted.select(*by, "wish", double_of(F.col("prefix")).alias("value"))


def median(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """(by, median): the exact median of each group, the mean of the two middle values where their number is even. Groups without a value give
    no row; without ``by`` there is one row, NULL without a value."""
    by = list(by)
    sizes = rows.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    middle = F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))
    wishes = stored(sizes.select(*by, F.explode(middle).alias("wish")), "median-wishes")
    found = order_statistics(rows, column, wishes, by)
    return found.groupBy(*by).agg(F.avg("value").alias("median"))


def range_bounds(rows: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 sortable longs that cut the values into ranges of about equal size, in ascending order.

    Cells are refined until they hold no more than a quarter of a range. Only the bounds reach the driver.
    """
    keys = rows.where(F.col(column).isNotNull()).select(sortable(F.col(column)).alias("key"))
    total = keys.count()
    if parts < 2 or total < 2:
        return []
    spark = rows.sparkSession
    schema = "prefix long, rank long, wish long"
    open_cells = [(0, max(1, total * i // parts), i) for i in range(1, parts)]
    bounds = set()
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        rows_now = _refine(keys, spark.createDataFrame(open_cells, schema), [], shift).collect()
        open_cells = [(r.prefix, r.rank, r.wish) for r in rows_now if shift and r["size"] * parts * 4 > total]
        bounds |= {r.prefix << shift for r in rows_now if not shift or r["size"] * parts * 4 <= total}
        if not open_cells:
            break
    return sorted(bounds)


def position(bounds: list[int], key: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by binary search in a literal array."""
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>") if bounds else F.array().cast("array<long>")  # folded to one literal
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(table, middle) <= key)
        return F.struct(
            F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])
