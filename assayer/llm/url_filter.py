"""URL filters by a cascade of Bloom filters.

Level 0 encodes the listed keys; level 1 the unlisted keys of the corpus that level 0 lets through; level 2 the listed keys that level 1
lets through; and so on until nothing gets through wrongly. Over the complete key universe of the corpus membership is then exact: the
first level that does not hold a key decides. A lookup needs no join, only the bits.

A rule is a host and the beginning of a path. The keys of a url are all rules that could fit it: its host and every
parent domain, with every beginning of its path that is as long as some rule's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import text as tx
from assayer.llm.shared import stored

HASHES = 4
BITS_PER_KEY = 8  # about 2 % of the other side get through a level
MAX_BITS = 1 << 31  # of all levels together, 256 MB; more listed keys than that need several lists
SEEDS = (101, 202)


@dataclass
class Cascade:
    """Bit arrays by level. Keys are pairs of 64-bit hashes."""

    levels: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _places(level: int, bits: int, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        step = tx.mix(b + tx.U64(2 * level + 1)) | tx.U64(1)
        at = tx.mix(a ^ tx.U64(0x51ED270B * (level + 1)))
        for k in range(HASHES):
            yield ((at + tx.U64(k) * step) % tx.U64(bits)).astype(np.int64)

    @staticmethod
    def bits(n: int) -> int:
        return -(-max(1, n) * BITS_PER_KEY // 8) * 8

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """A new level that holds these keys."""
        level, bits = len(self.levels), self.bits(len(a))
        held = np.zeros(bits // 8, dtype=np.uint8)
        for at in self._places(level, bits, a, b):
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.levels.append(held)

    def holds(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        held = self.levels[level]
        out = np.ones(len(a), dtype=bool)
        for at in self._places(level, len(held) * 8, a, b):
            out &= (held[at >> 3] >> (at & 7)) & 1 == 1
        return out

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed."""
        out = np.zeros(len(a), dtype=bool)
        left = np.arange(len(a))
        for level in range(len(self.levels)):
            inside = self.holds(level, a[left], b[left])
            out[left[~inside]] = level % 2 == 1
            left = left[inside]
        out[left] = len(self.levels) % 2 == 1
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. Both are
    empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Rules that could fit, longest first: for each (labels, length) the last labels of the host and the beginning of the path."""
    labels = F.size(F.split(host, r"\.", -1))
    keys = [
        F.when((labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in shapes
    ]
    found = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")
    longer = lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.array_sort(F.array_distinct(found), longer)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(seed)) for seed in SEEDS]


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels of the host, length of the path) of the rules: bounded by the longest host and path, not by their number."""
    rows = rules.select(F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("m")).distinct().collect()
    return sorted((r.n, r.m) for r in rows)


def build(urls: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]]) -> Cascade:
    """The cascade that separates the listed rules from all other keys of ``urls`` (``host``, ``path``) in these shapes.

    Only keys that a level lets through are gathered: the listed ones, and of the corpus the false positives, about
    2 % of its distinct keys.
    """
    spark = urls.sparkSession
    listed = rules.select(*[h.alias(n) for h, n in zip(_hashes(F.concat("host", "path")), "ab")]).distinct()
    listed = stored(listed, "listed")
    if Cascade.bits(listed.count()) * 2 > MAX_BITS:
        raise ValueError("the list is too large for one cascade; split it by host")
    out = Cascade()

    def pairs(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toArrow()
        return tuple(got.column(c).to_numpy().view(np.uint64) for c in "ab")

    a, b = pairs(listed)
    out.add(a, b)
    shared = spark.sparkContext.broadcast(out)

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cascade = shared.value
        for batch in batches:
            batch = batch.drop_duplicates()
            inside = cascade.holds(0, batch.a.to_numpy().view(np.uint64), batch.b.to_numpy().view(np.uint64))
            yield batch[inside]

    universe = urls.select(F.explode(candidates(F.col("host"), F.col("path"), shapes)).alias("key"))
    universe = universe.select(*[h.alias(n) for h, n in zip(_hashes(F.col("key")), "ab")])
    wrong = universe.mapInPandas(through, "a long, b long").distinct().join(listed, ["a", "b"], "left_anti")
    wrong = stored(wrong, "false-positives")
    if Cascade.bits(wrong.count()) * 2 > MAX_BITS:
        raise ValueError("too many keys of the corpus pass the first level; raise BITS_PER_KEY")
    here, there = pairs(wrong), (a, b)
    while len(here[0]):
        out.add(*here)
        inside = out.holds(len(out.levels) - 1, *there)
        here, there = (there[0][inside], there[1][inside]), here
    return out


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). The longest rule that fits decides; of repeated rules the
    verdict that sorts last (block) holds. Without one, ``rule`` is null and the verdict ``default``. Null or malformed urls have empty
    host and path, which no rule fits. An empty table of rules fits nothing; an empty table of pages gives no rows.
    Columns of those four names are replaced, others pass through.
    """
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host.alias("host"), path.alias("path"))
    # One cascade for each verdict: a key is in the one that its rule belongs to.
    kinds = sorted(r[0] for r in rules.select("verdict").distinct().collect())
    shapes = shapes_of(rules)
    cascades = spark.sparkContext.broadcast([build(urls, rules.where(F.col("verdict") == k), shapes) for k in kinds])

    @F.pandas_udf("array<int>")
    def verdicts(a: pd.Series, b: pd.Series) -> pd.Series:
        # position of the first listed candidate and its verdict, or two zeros
        sizes = np.array([len(x) for x in a], dtype=np.int64)
        flat = [np.concatenate(list(x)).view(np.uint64) if sizes.sum() else np.zeros(0, np.uint64) for x in (a, b)]
        kind = np.zeros(len(flat[0]), dtype=np.int64)
        for k, cascade in enumerate(cascades.value):
            kind[cascade.listed(*flat)] = k + 1
        ends = np.cumsum(sizes)
        hits = np.flatnonzero(kind)
        first = np.searchsorted(hits, ends - sizes)
        at = np.where(first < len(hits), hits[np.minimum(first, max(0, len(hits) - 1))] if len(hits) else 0, -1)
        good = (at >= ends - sizes) & (at < ends)
        return pd.Series([[int(p - e + n + 1), int(kind[p])] if g else [0, 0] for p, e, n, g in zip(at, ends, sizes, good)])

    keyed = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    hashed = [F.transform("keys", lambda key: _hashes(key)[0]), F.transform("keys", lambda key: _hashes(key)[1])]
    found = keyed.withColumn("found", verdicts(*hashed))
    verdict = F.lit(default)
    for k, name in enumerate(kinds):
        verdict = F.when(F.col("found")[1] == k + 1, F.lit(name)).otherwise(verdict)
    rule = F.when(F.col("found")[0] > 0, F.try_element_at("keys", F.greatest(F.col("found")[0], F.lit(1))))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def rules_of(spark: SparkSession, allow: list[str], block: list[str]) -> DataFrame:
    """Rules written as host and path in one string, such as ``net/``."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], kind) for kind, rules in (("allow", allow), ("block", block)) for r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")
