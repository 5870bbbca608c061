"""A corpus pipeline: language, repeated lines, near-duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, folder) and returns a table; ``run`` writes each result as Parquet in the shared folder and reads it
again for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm import decontaminate, language, line_dedup, near_dedup, packing
from assayer.llm.queries import table, tokenizer
from assayer.llm.shared import remainder, small, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SPARE = 0.3  # share of a document's characters in repeated lines beyond which it is a copy
LEAST_SHARE = 0.35  # pooled probability below which no language prevails in a document


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a letter in which one language prevails; mixed ones stay. A missing ``lang`` is filled with the prediction."""
    net = language.fit(docs, remainder(F.col("doc_id"), 3) != 1)
    found = language.identify(docs, net)
    known = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without repeated chunks of lines; ``n_chars`` counts what is left. A document that repeats for the most part is a copy: it stays whole, and the next stage
    decides about it. One of which no letter is left goes. Null texts stay null, repeated rows keep the same lines, an empty table stays empty."""
    found = line_dedup.dedup_lines(docs, spare=SPARE)
    changed = F.col("removed_lines") > 0
    left = found.where(~changed | F.col("text").rlike(r"\p{L}"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Of rows that repeat id and text one stays."""
    found = near_dedup.near_duplicates(docs)
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "gone")
    rows = docs.withColumn("__th", F.xxhash64("text"))
    same = rows.doc_id.eqNullSafe(F.col("gone_id")) & (rows["__th"] == F.col("gone_th"))
    first = F.row_number().over(Window.partitionBy("doc_id", "__th").orderBy(F.lit(0)))
    again = stored(rows.groupBy("doc_id", "__th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id"), F.col("__th").alias("gone_th")), "again")
    stay = rows.join(small(gone), same, "left_anti")
    repeated = stay.join(small(again), same, "left_semi").withColumn("n", first).where("n = 1")
    return stay.join(small(again), same, "left_anti").select(*COLUMNS).union(repeated.select(*COLUMNS))


def remove_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.leaks(docs, table(spark, folder, "benchmark")).select("doc_id", "th").distinct()
    found = stored(found.withColumnsRenamed({"doc_id": "leak_id", "th": "leak_th"}), "leaks")
    rows = docs.withColumn("__th", F.xxhash64("text"))
    return rows.join(small(found), rows.doc_id.eqNullSafe(F.col("leak_id")) & (rows["__th"] == F.col("leak_th")), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", remove_leaks),
    ("packing", pack),
]
ORACLE_SQL = None  # a trained network, signatures and a tokenizer: tests hold the stages against brute force


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
