"""Records of text files that may break anywhere, read in splits of any size.

Spark's text reader deals out byte ranges and gives every piece (the text up to a separator) to one of them. What a piece means depends on what came
before: a CSV line may begin inside a quoted field, the text behind a comma inside a JSON string or deep in brackets. So every split
is first read under both possible start states at once: which state and which bracket level each leads to, and how many pieces there are.
Composing these small tables file by file gives the true state, level and number of the first piece of each split. A second pass cuts the
records; one that crosses splits is put together from its parts. No task needs more than a split and one record.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.session import package_path, stored

SENT = 100_000  # splits whose start states are sent to all tasks; beyond that the pieces are sorted by split
PLAIN, INSIDE = 0, 1  # states of a piece's start: outside or inside a string

#: Pieces as Arrow strings -> state after each piece and change of level, both per start state (arrays 2 x n).
Step = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def lines_step(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines that never hang together."""
    n = len(pieces)
    return np.zeros((2, n), dtype=np.int8), np.zeros((2, n), dtype=np.int64)


def csv_step(sep: str) -> Step:
    """Lines of a CSV: a field that begins with a quote lasts to the next single quote, line breaks included."""

    def closed(line: str, at: int) -> int:
        """Where the quoted field that is open at ``at`` ends, or -1."""
        while True:
            at = line.find('"', at)
            if at < 0 or line[at + 1 : at + 2] != '"':
                return at
            at += 2

    def run(line: str, state: int) -> int:
        at = 0
        while True:
            if state == INSIDE:
                at = closed(line, at)
                if at < 0:
                    return INSIDE
                at = line.find(sep, at)
                if at < 0:
                    return PLAIN
                at, state = at + 1, PLAIN
            if line[at : at + 1] == '"':
                at, state = at + 1, INSIDE
                continue
            at = line.find(sep, at)
            if at < 0:
                return PLAIN
            at += 1

    def step(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        after = np.zeros((2, len(pieces)), dtype=np.int8)
        after[INSIDE] = INSIDE
        for k in np.flatnonzero(pc.match_substring(pieces, '"').to_numpy(zero_copy_only=False)).tolist():
            line = pieces[k].as_py()
            after[:, k] = run(line, PLAIN), run(line, INSIDE)
        return after, np.zeros((2, len(pieces)), dtype=np.int64)

    return step


def csv_row(record: str, sep: str) -> list[str]:
    """The fields of one CSV record."""
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([record], delimiter=sep), [])


def csv_fields(record: Column, sep: str) -> Column:
    """ARRAY<STRING>: the fields of CSV records."""

    def fields(records: pa.Array) -> pa.Array:
        return pa.array([None if r is None else csv_row(r, sep) for r in records.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(fields, "array<string>")(record)


def json_step(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What lies between commas of a JSON text: strings open and close, brackets outside them change the level."""
    n = len(pieces)
    whole = pieces.cast(pa.large_string())
    off = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + n + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    off = off - off[0] if n else np.zeros(1, np.int64)
    slash = np.flatnonzero(data == 0x5C)
    escaped = np.zeros(len(data) + 1, dtype=bool)
    if len(slash):
        piece = np.searchsorted(off, slash, "right")
        opens = np.append(True, (np.diff(slash) > 1) | (np.diff(piece) > 0))
        run = np.arange(len(slash)) - np.maximum.accumulate(np.where(opens, np.arange(len(slash)), 0))
        escaped[slash[run % 2 == 0] + 1] = True
        escaped[off] = False
    quote = (data == 0x22) & ~escaped[:-1]
    count = np.append(0, np.cumsum(quote))
    parity = (count[off[1:]] - count[off[:-1]]) % 2
    step = np.where((data == 0x5B) | (data == 0x7B), 1, np.where((data == 0x5D) | (data == 0x7D), -1, 0))
    at = np.flatnonzero(step)
    own = np.searchsorted(off, at, "right") - 1
    inside = (count[at] - count[off[own]]) % 2
    level = np.array([np.bincount(own[inside == s], step[at[inside == s]], n) for s in (PLAIN, INSIDE)]).astype(np.int64).reshape(2, n)
    return np.array([parity, 1 - parity], dtype=np.int8).reshape(2, n), level


def _walk(after: np.ndarray, state: int) -> np.ndarray:
    """The state before each piece and after the last one. Pieces with one outcome set the state, the others keep or swap it."""
    fixed = after[0] == after[1]
    swaps = np.append(0, np.cumsum(~fixed & (after[0] == INSIDE)))
    number = np.arange(1, after.shape[1] + 1)
    last = np.append(0, np.maximum.accumulate(np.where(fixed, number, 0)))
    base = np.where(last > 0, np.append(state, after[0])[last], state)
    return (base + swaps - swaps[last]) % 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of pieces of one split."""
    code = pc.run_end_encode(batch.column("block")).run_ends.to_numpy()
    names = batch.column("source_file").dictionary_encode()
    file = pc.run_end_encode(names.indices).run_ends.to_numpy()
    at = 0
    for to in np.unique(np.concatenate([code, file])).tolist():
        part = batch.slice(at, to - at)
        yield part.column("source_file")[0].as_py(), part.column("block")[0].as_py(), part
        at = to


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(value, source_file, block): pieces in the order of the file; ``block`` is where the split begins."""
    package_path(spark)
    place = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", sep).text(path).select("value", *place)


def _effects(pieces: DataFrame, step: Step) -> DataFrame:
    """What each split does: its number of pieces, and per start state the end state and the change of level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, states, levels = None, 0, [0, 1], [0, 0]

        def row() -> pa.RecordBatch:
            values = [now[0], now[1], n, *states, *levels]
            return pa.RecordBatch.from_arrays([pa.array([v]) if k == 0 else pa.array([v], pa.int64()) for k, v in enumerate(values)], names)

        for batch in batches:
            for file, block, part in _runs(batch):
                if now != (file, block):
                    if now is not None:
                        yield row()
                    now, n, states, levels = (file, block), 0, [0, 1], [0, 0]
                after, level = step(part.column("value"))
                n += len(part)
                for s in (0, 1):
                    path = _walk(after, states[s])
                    levels[s] += int(level[path[:-1], np.arange(len(part))].sum())
                    states[s] = int(path[-1])
        if now is not None:
            yield row()

    names = ["source_file", "block", "n", "end0", "end1", "up0", "up1"]
    return pieces.mapInArrow(run, "source_file string, block long, n long, end0 long, end1 long, up0 long, up1 long")


def _starts(effects: DataFrame) -> DataFrame:
    """(source_file, block, state, level, line, last): how each split begins, and whether it is its file's last one. One short row per split is
    composed in the order of the file."""
    listed = effects.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("block", "n", "end0", "end1", "up0", "up1"))).alias("b"))
    first = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("level"), F.lit(1).cast("long").alias("line"))
    out = "array<struct<block:long,state:long,level:long,line:long>>"

    def add(s, b):
        now = s["now"]
        plain = now["state"] == PLAIN
        following = F.struct(
            F.when(plain, b["end0"]).otherwise(b["end1"]).alias("state"),
            (now["level"] + F.when(plain, b["up0"]).otherwise(b["up1"])).alias("level"), (now["line"] + b["n"]).alias("line"),
        )
        here = F.struct(b["block"].alias("block"), now["state"].alias("state"), now["level"].alias("level"), now["line"].alias("line"))
        return F.struct(following.alias("now"), F.concat(s["out"], F.array(here)).alias("out"))

    start = F.struct(first.alias("now"), F.array().cast(out).alias("out"))
    composed = listed.select("source_file", F.aggregate("b", start, add, lambda s: s["out"]).alias("out"), F.element_at("b", -1)["block"].alias("end"))
    return composed.select("source_file", "end", F.inline("out")).withColumn("last", F.col("block") == F.col("end")).drop("end")


def _with_starts(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Pieces with the start of their split, in order inside each split."""
    keys = ["source_file", "block"]
    if starts.count() <= SENT:
        return pieces.join(F.broadcast(starts), keys)
    numbered = pieces.withColumn("__ord", F.monotonically_increasing_id())
    return numbered.join(starts, keys).repartition(*keys).sortWithinPartitions(*keys, "__ord").drop("__ord")


PARTS = "source_file string, block long, line long, value string, number long, opens boolean, closes boolean, final boolean"


def _parts(pieces: DataFrame, step: Step, sep: str, base: int) -> DataFrame:
    """Records and parts of records: ``opens`` where the record begins in this split, ``closes`` where it ends there. A record ends after a piece
    that leaves strings and is on level ``base``, or with its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, level, line = None, 0, 0, 0
        held: list[str] = []
        latest: list[tuple] = []
        begun, number, opens, last = 0, 0, True, False

        def rest() -> list[tuple]:
            """What is left of a split. Its latest record waits in ``latest`` until it is known whether another one follows."""
            if held:
                return [*latest, (now[0], now[1], begun, sep.join(held), number, opens, last, last)]
            return [(*row[:-1], last) for row in latest]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
            names = ["source_file", "block", "line", "value", "number", "opens", "closes", "final"]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            out: list[tuple] = []
            for file, block, part in _runs(batch):
                if now != (file, block):
                    out += rest()
                    now, held, latest = (file, block), [], []
                    state, level, line = (part.column(c)[0].as_py() for c in ("state", "level", "line"))
                    last = part.column("last")[0].as_py()
                    opens = (state == PLAIN and level == base) or line == 1
                    begun, number = line, 0 if opens else -1
                texts = part.column("value")
                after, change = step(texts)
                path = _walk(after, state)
                levels = level + np.cumsum(change[path[:-1], np.arange(len(part))])
                ends = np.flatnonzero((path[1:] == PLAIN) & (levels == base))
                values = texts.to_pylist()
                at = 0
                for to in (ends + 1).tolist():
                    held += values[at:to]
                    out += latest
                    latest = [(file, block, begun, held[0] if len(held) == 1 else sep.join(held), number, opens, True, False)]
                    held, at, begun, number, opens = [], to, line + to, number + 1, True
                held += values[at:]
                state, level, line = int(path[-1]), int(levels[-1]), line + len(part)
            if out:
                yield table(out)
        yield table(rest() if now else [])

    return pieces.select("value", "source_file", "block", "state", "level", "line", "last").mapInArrow(run, PARTS)


def records(spark: SparkSession, path: str, step: Step, *, sep: str = "\n", base: int = 0) -> DataFrame:
    """(source_file, block, number, line, value, final): records of text files. ``line`` is the number of a record's first piece, counted from 1 in its
    file, ``number`` counts the records that begin in split ``block`` from 0, and ``final`` marks the last one of a file, which its end may have cut.

    An empty file has no records. Files are read twice, in splits of any size.
    """
    pieces = _pieces(spark, path, sep)
    starts = stored(_starts(_effects(pieces, step)), "split-starts")
    parts = stored(_parts(_with_starts(pieces, starts), step, sep, base), "split-parts")
    broken = parts.where(~(F.col("opens") & F.col("closes")))
    before = Window.partitionBy("source_file").orderBy("block", F.col("opens").asc()).rowsBetween(Window.unboundedPreceding, 0)
    opener = F.last(F.when(F.col("opens"), F.struct("line", "block", "number")), ignorenulls=True).over(before)
    joined = broken.withColumn("first", opener).groupBy("source_file", "first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), sep).alias("value"),
        F.max("final").alias("final"),
    )
    columns = ["source_file", "block", "number", "line", "value", "final"]
    whole = parts.where(F.col("opens") & F.col("closes")).select(*columns)
    return whole.unionByName(joined.select("source_file", "first.block", "first.number", "first.line", "value", "final"))


def positions(found: DataFrame) -> DataFrame:
    """The records with ``position``, their number in their file from 0. Only one count per split is added up."""
    counts = found.groupBy("source_file", "block").agg((F.max("number") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source_file", "block", F.coalesce(before, F.lit(0)).alias("skipped"))
    return found.join(offsets, ["source_file", "block"]).withColumn("position", F.col("skipped") + F.col("number")).drop("skipped")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line, value) of every line."""
    return records(spark, path, lines_step).select("source_file", "line", "value")
