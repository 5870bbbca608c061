"""Row sources: JSON lines, JSON arrays, CSV/TSV and Parquet, benchmark cases, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.constants import MAX_BODY_BYTES
from assayer.functions import json as J
from assayer.sources.split import csv_fields, csv_row, csv_step, json_step, numbered_lines, positions, records

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_file, problem): one row per non-blank line; ``problem`` names a line that is
    no strict JSON object."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    kept = lines.filter(F.trim("value", F.lit(" \t\r\n")) != "")
    return kept.withColumn("problem", object_problem(F.col("value")))


def object_problem(text: Column) -> Column:
    return F.when(~J.strict(text), "strict_json").when(J.text_kind(text) != "object", "object")


def located(bad: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Line numbers of bad lines, from one more pass over the files in splits."""
    files = bad.select("source_file").distinct()
    lines = numbered_lines(spark, path).join(files, "source_file", "left_semi")
    lines = lines.withColumn("problem", F.when(F.trim("value", F.lit(" \t\r\n")) != "", object_problem(F.col("value"))))
    return lines.filter(F.col("problem").isNotNull()).select("source_file", "line", "value", "problem")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(value, position, source_file): elements of files that each hold an array of objects, as they are written there. Files are read in splits, of any size;
    one that is no array of strict objects is an error. An element may be larger than a split."""
    wrong = "the file is no array of objects"
    found = positions(records(spark, path, json_step, sep=",", base=1))
    text, first = F.col("value"), F.col("line") == 1
    begins, ends = r"^[\uFEFF]?[ \t\r\n]*\[", r"\][ \t\r\n]*$"
    fits = (~first | text.rlike(begins)) & (~F.col("final") | text.rlike(ends))
    inner = F.when(first, F.regexp_replace(text, begins, "")).otherwise(text)
    inner = F.when(F.col("final"), F.regexp_replace(inner, ends, "")).otherwise(inner)
    rows = found.select(F.trim(inner, F.lit(" \t\r\n")).alias("value"), "position", "source_file", fits.alias("fits"), (first & F.col("final")).alias("only"))
    rows = rows.where(~(F.col("only") & F.col("fits") & (F.col("value") == "")))
    sound = F.col("fits") & object_problem(F.col("value")).isNull()
    return rows.withColumn("sound", sound).select(
        F.when(F.col("sound"), F.col("value")).otherwise(F.raise_error(wrong).cast("string")).alias("value"), F.col("position").cast("int").alias("position"), "source_file"
    )


def read_delimited(spark: SparkSession, path: str, *, sep: str = ",", strict: bool = True) -> DataFrame:
    """CSV or TSV with unique header names, the same in every file. Every value stays a string, empty ones too; a ragged row is an error, or
    with ``strict=False`` a row whose ``_corrupt`` column holds the text. Quoted fields may hold line breaks; files are still read in splits. Blank lines are no rows."""
    found = records(spark, path, csv_step(sep)).select(F.regexp_replace("value", r"\r$", "").alias("value"), "line")
    heads = found.where("line = 1").select(F.regexp_replace("value", "^\uFEFF", "").alias("h")).distinct().take(2)
    if not heads or not heads[0]["h"]:
        raise ValueError("the first line has no column names")
    if len(heads) > 1:
        raise ValueError("the files have different column names")
    columns = csv_row(heads[0]["h"], sep)
    if len(columns) != len(set(columns)):
        raise ValueError("column names repeat")
    rows = found.where("line > 1 and value <> ''").withColumn("fields", csv_fields(F.col("value"), sep))
    broken = F.size("fields") != len(columns)
    named = [F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    if not strict:
        return rows.select(*named, F.when(broken, F.col("value")).alias(CORRUPT))
    first = F.when(broken, F.raise_error("a row does not fit the columns").cast("string")).otherwise(named[0])
    return rows.select(first.alias(columns[0]), *named[1:])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases: one row per (id, qid) with type, ordered gold keys, probabilities, label."""
    rows = spark.read.parquet(path).select("id", "state", "questions", "gold")
    return gold_rows(rows)


def gold_rows(cases: DataFrame) -> DataFrame:
    """Explode the ``gold`` JSON of benchmark cases."""
    gold = cases.select("id", "state", "questions", F.explode(J.entries(F.col("gold"))).alias("e"))
    gold = gold.select("id", "state", F.col("e.key").alias("qid"), J.entries(F.col("e.json")).alias("m"))
    p = J.entries(J.member(F.col("m"), "probabilities"))
    text = lambda n: F.get(F.filter("m", lambda e: e["key"] == n), F.lit(0))["text"]
    return gold.select(
        "id", "state", "qid", text("type").alias("type"), text("label").alias("label"),
        F.transform(p, lambda e: e["key"]).alias("keys"),
        F.transform(p, lambda e: e["text"].cast("double")).alias("g"),
    )


def finite_report(df: DataFrame) -> DataFrame:
    """The same rows; a NaN or infinite double fails the job, so a report never holds one."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            c = F.when(bad, F.raise_error(f"non-finite value in {f.name}").cast(f.dataType)).otherwise(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def append_report(df: DataFrame, path: str) -> None:
    finite_report(df).write.mode("append").json(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"empty dataset: {what}")
    return df


def bounded_body(text: Column) -> Column:
    return F.octet_length(text).between(1, MAX_BODY_BYTES)
