"""The canonical record table: Parquet with the record text, its fingerprint and the few columns that planning reads.

The format's name lies in the metadata of a column, so it is part of every file's footer and the reader knows a foreign table before it reads a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import json as J

FORMAT = "canonical-records-1"
PLANNED = ("id", "dataset", "split_group", "split_group_inferred", "fingerprint")


def write_canonical(records: DataFrame, path: str, text: str = "record_json") -> None:
    """Write typed records with their text. An empty table is an error; the fingerprint is the digest of the text with sorted keys."""
    if records.isEmpty():
        raise ValueError("empty dataset")
    columns = [F.col(c) for c in ("id", "dataset", "split_group", "split_group_inferred")]
    rows = records.select(*columns, F.sha2(J.canonical(F.col(text)), 256).alias("fingerprint"), F.col(text).alias("record_json"))
    rows.withMetadata("record_json", {"format": FORMAT}).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """The whole table. A table without the format's name in its footers is an error."""
    rows = spark.read.parquet(path)
    field = next((f for f in rows.schema.fields if f.name == "record_json"), None)
    if field is None or field.metadata.get("format") != FORMAT:
        raise ValueError(f"{path} holds no canonical records")
    return rows


def planned(spark: SparkSession, path: str) -> DataFrame:
    """Ids, groups and fingerprints; record texts are never read."""
    return read_canonical(spark, path).select(*PLANNED)


def footer_facts(spark: SparkSession, path: str, columns: list[str]) -> dict:
    """Number of rows, and for each column the number of values and the least and greatest one, from the statistics in the footers: no row is read. Columns whose
    statistics a file lacks are scanned by Spark as usual."""
    names = ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "")
        spark.conf.set(names[1], "true")
        read_canonical(spark, path)
        facts = [F.count(F.lit(1)).alias("rows")]
        for c in columns:
            facts += [F.count(c).alias(f"{c}_values"), *([] if dict(spark.read.parquet(path).dtypes)[c] in ("string", "binary") else [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")])]
        return spark.read.parquet(path).agg(*facts).first().asDict()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
