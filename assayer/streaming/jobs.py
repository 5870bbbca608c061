"""Streaming forms of the operators. Every function takes a streaming DataFrame and returns one, or
a foreachBatch writer whose output is keyed by batch id, so a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.buckets import probability_bin
from assayer.functions.tape import numeric_leaves
from assayer.operators.answers import answers
from assayer.operators.validate import admission
from assayer.session import fresh_path


def route_requests(
    good: str, dead: str, *, model: str | None = None, text: str = "value", tokens: Column | None = None, budget: int | None = None
) -> Callable:
    """Writer for a stream of request bodies: usable ones to ``good``, others with their error class to ``dead``: "capacity" for a body with more
    ``tokens`` than ``budget``, "invalid_request" for all else. Both outputs come from one evaluation of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kind = F.when(F.col("admission") == "budget", "capacity").otherwise("invalid_request")
        checked = admission(batch, text, model, tokens=tokens, budget=budget)
        checked = checked.withColumn("error", F.when(F.col("admission").isNotNull(), kind)).persist()
        try:
            usable = checked.filter(F.col("admission").isNull()).drop("admission", "error")
            usable.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            checked.filter(F.col("admission").isNotNull()).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        finally:
            checked.unpersist()

    return write


def stream_answers(predictions: DataFrame, temperatures: DataFrame | None = None) -> DataFrame:
    """Typed answers of a prediction stream; the temperature table is joined as a static side."""
    return answers(predictions, temperatures)


def distinct_states(rows: DataFrame, state: Column, time: str, delay: str) -> DataFrame:
    """The first row of each state within the watermark delay. ``reuse.reuse_states`` also hands the encoded value to later rows."""
    return (
        rows.withColumn("state_sha", F.sha2(state, 256))
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark(["state_sha"])
    )


def leakage_gate(spark: SparkSession, sources: str, accepted: str, rejected: str, split: str) -> Callable:
    """Writer that refuses records whose key belongs to another split, and adds the keys of the
    accepted ones to the sources. Both outputs are keyed by batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.parquet(sources).filter(F.col("batch") != batch_id)
        other = known.filter(F.col("split") != split).select("key").distinct()
        bad = batch.join(other, batch["split_group"] == other["key"], "left_semi")
        good = batch.join(other, batch["split_group"] == other["key"], "left_anti")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        good.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        good.select(F.lit(split).alias("split"), F.col("split_group").alias("key")).distinct().write.mode(
            "overwrite"
        ).parquet(f"{sources}/batch={batch_id}")

    return write


def log_metrics(rows: DataFrame, text: str, time: str, *, delay: str, window: str, slide: str | None = None) -> DataFrame:
    """Mean, extremes and count of every number of a JSON log per window, however deep its objects nest."""
    leaves = rows.withWatermark(time, delay).select(time, F.inline(numeric_leaves(F.col(text))))
    return leaves.groupBy(F.window(time, window, slide).alias("w"), "name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).select(F.col("w.start").alias("start"), "name", "n", "mean", "low", "high")


def throughput(rows: DataFrame, time: str, amounts: list[str], *, delay: str, window: str) -> DataFrame:
    """Per window: rows, the sum of each amount, and both per second of the time between the window's first and last row (NULL for one moment)."""
    seconds = F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))
    sums = rows.withWatermark(time, delay).groupBy(F.window(time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(a).alias(a) for a in amounts], (seconds / 1e6).alias("seconds")
    )
    rate = lambda c: F.try_divide(F.col(c).cast("double"), F.col("seconds")).alias(f"{c}_per_second")
    return sums.select(F.col("w.start").alias("start"), "rows", *amounts, "seconds", *[rate(c) for c in ("rows", *amounts)])


def calibration_bins(
    rows: DataFrame, time: str, *, delay: str, window: str, slide: str | None = None
) -> DataFrame:
    """Weight, confidence and correctness sums per (window, bin); late rows drop at the watermark."""
    w = F.col("weight")
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, window, slide).alias("w"), probability_bin(F.col("top_probability")).alias("bin"))
        .agg(F.sum(w).alias("s_w"), F.sum(w * F.col("top_probability")).alias("s_top"),
             F.sum(w * F.col("accuracy")).alias("s_hit"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "bin", "s_w", "s_top", "s_hit", "n")
    )


def calibration_by_window(bins: DataFrame) -> DataFrame:
    """Calibration error of each window from the emitted bins (ten rows per window)."""
    return bins.groupBy("start").agg(
        (F.sum(F.abs(F.col("s_top") - F.col("s_hit"))) / F.sum("s_w")).alias("ece"),
        (F.sum("s_hit") / F.sum("s_w")).alias("accuracy"), F.sum("n").alias("n"),
    )


def run_to_table(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and read the result back as a table."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_batches(stream: DataFrame, writer: Callable) -> None:
    """Run a stream over what is available through a foreachBatch writer."""
    path = fresh_path(stream.sparkSession, "batches")
    query = (
        stream.writeStream.foreachBatch(writer).option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
