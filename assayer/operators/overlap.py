"""Text shared between evaluation rows and training texts, by word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import grams as G
from assayer.session import package_path, stored

GRAM_WORDS = 8
BITS_EACH = 16  # bits of the filter per evaluation n-gram
MOST_BITS = 1 << 30  # of the filter; with more n-grams it lets more through, and the join still decides
_CELL = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def _filter(known: DataFrame) -> np.ndarray:
    """A bit per hash, hash modulo the number of bits: built as bitmaps on Spark, at most MOST_BITS / 8 bytes here."""
    wanted = max(_CELL, known.count() * BITS_EACH)
    bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    place = F.pmod(F.col("h"), F.lit(bits)) + 1  # positions of bitmaps count from 1
    maps = known.select(F.bitmap_bucket_number(place).alias("cell"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in maps.groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("map")).toLocalIterator():
        out[(row.cell - 1) * (_CELL // 8) : row.cell * (_CELL // 8)] = np.frombuffer(row.map, dtype=np.uint8)
    return out


def _grams(rows: DataFrame, text: str, n: int, key: str | None = None, bits=None) -> DataFrame:
    """(h, gram) of the n-grams of each text, with the row's ``key`` if one is named; with ``bits`` only those whose bit is set. Repeats inside a batch go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else bits.value
        for batch in batches:
            row, hashes, texts = [], [], []
            for at, data, begin, end, own, whole in G.hashed(batch.column("text"), n):
                hit = np.flatnonzero(own >= 0)
                if known is not None:
                    place = (whole[hit] & np.uint64(len(known) * 8 - 1)).astype(np.int64)
                    hit = hit[(known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                same = whole[hit] if key is None else np.stack([own[hit].astype(np.uint64), whole[hit]])
                hit = hit[np.unique(same, return_index=True, axis=None if key is None else 1)[1]]
                row.append(own[hit] + at)
                hashes.append(whole[hit].view(np.int64))
                texts += [G.text_of(data, begin, end, k, n) for k in hit.tolist()]
            columns = [pa.array(np.concatenate(hashes) if hashes else [], pa.int64()), pa.array(texts, pa.string())]
            names = ["h", "gram"]
            if key is not None:
                columns.append(batch.column("key").take(pa.array(np.concatenate(row) if row else [], pa.int64())))
                names.append("key")
            yield pa.RecordBatch.from_arrays(columns, names)

    package_path(rows.sparkSession)
    picked = rows.select(F.col(text).cast("string").alias("text"), *([F.col(key).alias("key")] if key else []))
    kind = "h long, gram string" + (f", key {picked.schema['key'].dataType.simpleString()}" if key else "")
    return picked.mapInArrow(run, kind)


def text_overlap(rows: DataFrame, texts: DataFrame, key: str, *, text: str = "text", n: int = GRAM_WORDS) -> DataFrame:
    """Per evaluation row: its distinct ``grams`` (runs of ``n`` words, A-Z lower-cased) and how many were ``seen`` in the training texts. A row overlaps when
    ``seen`` is not 0.

    The evaluation side's n-grams become a bit filter that every task holds. Of the training texts only n-grams whose bit is set leave the task that read
    them, each once per batch, and the words themselves decide. NULL and short texts have no n-grams; rows that share a key count as one.
    """
    own = stored(_grams(rows, text, n, key).distinct(), "own-grams")
    bits = rows.sparkSession.sparkContext.broadcast(_filter(own.select("h").distinct()))
    found = _grams(texts, text, n, bits=bits)
    seen = found.join(own.select("h", "gram").distinct(), ["h", "gram"], "left_semi").distinct()
    counts = own.join(seen.withColumn("hit", F.lit(1)), ["h", "gram"], "left").groupBy("key").agg(
        F.count(F.lit(1)).alias("grams"), F.count("hit").alias("seen")
    )
    zero = F.lit(0).cast("long")
    return rows.select(key).join(counts.withColumnRenamed("key", "__key"), rows[key].eqNullSafe(F.col("__key")), "left").select(
        key, F.coalesce("grams", zero).alias("grams"), F.coalesce("seen", zero).alias("seen")
    )
