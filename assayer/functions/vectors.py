"""Short numeric vectors in two forms with one set of formulas.

``Lanes`` spreads a vector over separate double columns, so every formula stays inside whole-stage
codegen; rows with fewer entries carry NULL lanes. ``Arrays`` keeps one ARRAY<DOUBLE> column and
works for any length. Both skip NULL entries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _add(a: Column, b: Column) -> Column:
    return a + b


class Lanes:
    """One column per entry."""

    def __init__(self, lanes: list[Column]):
        self.lanes = list(lanes)

    @classmethod
    def of(cls, array: Column, width: int) -> "Lanes":
        return cls([F.get(array, F.lit(i)) for i in range(width)])

    def map(self, fn: Callable[[Column], Column]) -> "Lanes":
        return Lanes([fn(x) for x in self.lanes])

    def zip(self, other: "Lanes", fn: Callable[[Column, Column], Column]) -> "Lanes":
        return Lanes([fn(a, b) for a, b in zip(self.lanes, other.lanes)])

    def total(self) -> Column:
        return reduce(_add, [F.coalesce(x, F.lit(0.0)) for x in self.lanes])

    def weighted_index(self) -> Column:
        """Sum of index times entry."""
        return reduce(_add, [F.coalesce(x, F.lit(0.0)) * i for i, x in enumerate(self.lanes)])

    def maximum(self) -> Column:
        return F.greatest(*self.lanes) if len(self.lanes) > 1 else self.lanes[0]

    def first_at(self, value: Column) -> Column:
        """Index of the first entry equal to value."""
        out = F.when(self.lanes[0] == value, 0)
        for i, x in enumerate(self.lanes[1:], 1):
            out = out.when(x == value, i)
        return out

    def at(self, index: Column) -> Column:
        out = F.when(index == 0, self.lanes[0])
        for i, x in enumerate(self.lanes[1:], 1):
            out = out.when(index == i, x)
        return out

    def spread(self, index: Column) -> Column:
        """Sum of entry times its distance from index."""
        return reduce(
            _add, [F.coalesce(x, F.lit(0.0)) * F.abs(i - index) for i, x in enumerate(self.lanes)]
        )

    def prefix(self) -> "Lanes":
        """Running sums without the last entry of the row."""
        out, run = [], None
        for i, x in enumerate(self.lanes[:-1]):
            run = x if run is None else run + x
            out.append(F.when(self.lanes[i + 1].isNotNull(), run))
        return Lanes(out)

    def array(self) -> Column:
        return F.filter(F.array(*self.lanes), lambda x: x.isNotNull())

    def save(self, df: DataFrame, name: str) -> tuple[DataFrame, "Lanes"]:
        names = [f"__{name}_{i}" for i in range(len(self.lanes))]
        df = df.withColumns(dict(zip(names, self.lanes)))
        return df, Lanes([F.col(n) for n in names])


class Arrays:
    """One array column of any length."""

    def __init__(self, column: Column):
        self.column = column

    def map(self, fn: Callable[[Column], Column]) -> "Arrays":
        return Arrays(F.transform(self.column, fn))

    def zip(self, other: "Arrays", fn: Callable[[Column, Column], Column]) -> "Arrays":
        return Arrays(F.zip_with(self.column, other.column, fn))

    def total(self) -> Column:
        return F.aggregate(self.column, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

    def weighted_index(self) -> Column:
        indexed = F.transform(self.column, lambda x, i: x * i)
        return F.aggregate(indexed, F.lit(0.0), lambda s, x: s + x)

    def maximum(self) -> Column:
        return F.array_max(self.column)

    def first_at(self, value: Column) -> Column:
        return (F.array_position(self.column, value) - 1).cast("int")

    def at(self, index: Column) -> Column:
        return F.get(self.column, index)

    def spread(self, index: Column) -> Column:
        far = F.transform(self.column, lambda x, i: x * F.abs(i - index))
        return F.aggregate(far, F.lit(0.0), lambda s, x: s + x)

    def prefix(self) -> "Arrays":
        head = F.slice(self.column, 1, F.greatest(F.size(self.column) - 1, F.lit(0)))
        return Arrays(
            F.transform(
                head,
                lambda _x, i: F.aggregate(
                    F.slice(self.column, 1, i + 1), F.lit(0.0), lambda s, x: s + x
                ),
            )
        )

    def array(self) -> Column:
        return self.column

    def save(self, df: DataFrame, name: str) -> tuple[DataFrame, "Arrays"]:
        return df.withColumn(f"__{name}", self.column), Arrays(F.col(f"__{name}"))


def saved_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("__")]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def as_doubles(array: Column) -> Column:
    return array.cast("array<double>")
