"""Tables written to the shared folder, row selection by hash, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import fresh_path

#: Rows of a key table that is sent to every executor, about 40 bytes each. Larger ones are shuffled.
BROADCAST_ROWS = 500_000


def stored(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """The table, written once to the shared folder. Later reads survive a lost executor. ``made`` collects the paths of tables that can be discarded."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete stored tables that no later table reads."""
    for path in made:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    made.clear()


def small(df: DataFrame) -> DataFrame:
    """A stored table of short rows, marked for broadcast only if its counted size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(0))


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the smallest node reachable.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing
    changes: logarithmically many steps in practice, and no group is gathered in one task, since each step takes a
    minimum per node (combined before the shuffle) and one join that adaptive execution can split. The minima go by broadcast if
    the counted edges allow it. A large-star step gives at most one row per edge, so its repeated rows can stay until the next one.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    seen = _digest(edges)
    while seen[0]:
        near = F.broadcast if 2 * seen[0] <= BROADCAST_ROWS else lambda df: df  # an edge has two nodes
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(
            both.where("v > u").join(near(least), "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")),
            "large-star",
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        step = large.join(near(least), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(step.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
