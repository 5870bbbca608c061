"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant in alternation, ending with the assistant. A small automaton
accepts them; its states are what the last turn was. For each turn the repair can take it as it is, relabel it, merge it into the turn
before it, or insert an empty turn first, each at a price. The cheapest way through the automaton is the repair.

A turn's choices are a matrix of costs between states, and matrices combine in any grouping. So conversations need no task of their own: turns
are sorted by (conversation, turn) over range partitions and cut into blocks of BLOCK_TURNS, each block gives one matrix, the matrices of a
conversation give every block's first and last state, and the blocks are then repaired and rendered independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import stored

BLOCK_TURNS = 4096
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the role of the last turn
ROLES = ("", "system", "user", "assistant")
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 2, 3, 4  # prices; a merge under another role pays both
NEVER = 1 << 40


def _choices(role: str | None) -> list[tuple[int, int, int, str]]:
    """(state before, state after, price, action) for a turn of this role, the preferred one first among equals."""
    out = []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            label = 0 if ROLES[after] == role else RELABEL
            if after in FOLLOWS[before]:
                out.append((before, after, label, "relabel" if label else "keep"))
            for between in FOLLOWS[before]:
                if after in FOLLOWS[between]:
                    out.append((before, after, INSERT + label, f"insert {ROLES[between]}" + (" relabel" if label else "")))
        if before != START:
            label = 0 if ROLES[before] == role else RELABEL
            out.append((before, before, MERGE + label, "merge" + (" relabel" if label else "")))
    return sorted(out, key=lambda c: c[2])


CHOICES = {role: _choices(role) for role in (*ROLES[1:], None)}
#: Price of ending in a state, and the empty turns that pay for it.
ENDINGS = {START: (0, ()), SYSTEM: (2 * INSERT, ("user", "assistant")), USER: (INSERT, ("assistant",)), ASSISTANT: (0, ())}


def _known(role) -> str | None:
    return role if role in ROLES[1:] else None


def matrix(roles: list) -> np.ndarray:
    """Cheapest price from each state to each state over these turns."""
    cost = np.full((4, 4), NEVER, dtype=np.int64)
    np.fill_diagonal(cost, 0)
    for role in roles:
        new = np.full((4, 4), NEVER, dtype=np.int64)
        for before, after, price, _ in CHOICES[_known(role)]:
            np.minimum(new[:, after], cost[:, before] + price, out=new[:, after])
        cost = np.minimum(new, NEVER)
    return cost


def path(roles: list, first: int, last: int) -> list[tuple[int, str]]:
    """(state after, action) of each turn on the cheapest way between two states. Ties go to the choice that is listed first, decided from
    the last turn backwards."""
    cost = np.full(4, NEVER, dtype=np.int64)
    cost[first] = 0
    costs = [cost]
    for role in roles:
        new = np.full(4, NEVER, dtype=np.int64)
        for before, after, price, _ in CHOICES[_known(role)]:
            new[after] = min(new[after], cost[before] + price)
        cost = new
        costs.append(cost)
    out, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        ways = (c for c in CHOICES[_known(roles[i])] if c[1] == state and costs[i][c[0]] + c[2] == costs[i + 1][state])
        before, _, _, action = next(ways)
        out.append((state, action))
        state = before
    return out[::-1]


def chain(matrices: list[np.ndarray]) -> tuple[list[int], int]:
    """States before each block and after the last one, and the whole price with its ending."""
    cost = np.full(4, NEVER, dtype=np.int64)
    cost[START] = 0
    costs = [cost]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    total = [int(costs[-1][s]) + ENDINGS[s][0] for s in range(4)]
    state = int(np.argmin(total))
    states = [state]
    for m, cost in zip(matrices[::-1], costs[-2::-1]):
        state = int(np.argmin(cost + m[:, state]))
        states.append(state)
    return states[::-1], min(total)


def render(role: str) -> str:
    return f"<|{role}|>\n"


CLOSE = "\n<|end|>\n"
JOINT = "\n\n"  # between texts of merged turns


KEY = ("none", "conv", "block")  # whether the conversation's id is null, the id or 0, and the block's number


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, for batches sorted by ``KEY``."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        values = [table.column(c).to_numpy() for c in KEY]
        if held and [held[-1].column(c)[0].as_py() for c in KEY] != [v[0] for v in values]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        change = np.any([v[1:] != v[:-1] for v in values], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1), len(batch)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            held.append(table.slice(i, j - i))
            if k < len(cuts) - 2:
                yield pa.concat_tables(held).combine_chunks()
                held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``: the row's place among those of its conversation in this partition."""
    before, n = None, 0
    for batch in batches:
        out = []
        for key in zip(batch.column("none").to_pylist(), batch.column("conv").to_pylist()):
            n = n + 1 if key == before else 0
            before = key
            out.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "at"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _blocks(batches):
        columns = [part.column(c).slice(0, 1).combine_chunks() for c in KEY]
        cost = pa.array([matrix(part.column("role").to_pylist()).ravel().tolist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns, cost], [*KEY, "cost"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From one row per conversation with its matrices (one number in 256 of its turns): the states around each block."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in (*KEY, "first", "last", "ending")}
        for none, conv, parts in zip(*(batch.column(c).to_pylist() for c in ("none", "conv", "parts"))):
            found, _ = chain([np.array(p["cost"]).reshape(4, 4) for p in parts])
            for k, p in enumerate(parts):
                for name, value in zip(out, (none, conv, p["block"], found[k], found[k + 1], k + 1 == len(parts))):
                    out[name].append(value)
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "place", "turn", "role", "action", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for part in _blocks(batches):
        roles, texts, numbers, index = (part.column(c).to_pylist() for c in ("role", "text", "turn", "index"))
        state, last, ending, none, conv = (part.column(c)[0].as_py() for c in ("first", "last", "ending", "none", "conv"))
        out: list[tuple] = []
        for (after, action), text, number, i in zip(path(roles, state, last), texts, numbers, index):
            close = "" if state == START else CLOSE
            if action.startswith("insert"):
                name = action.split()[1]
                out.append((2 * i, None, name, "insert", close + render(name)))
                close, action = CLOSE, "relabel" if action.endswith("relabel") else "keep"
            head = JOINT if action.startswith("merge") else close + render(ROLES[after])
            out.append((2 * i + 1, number, ROLES[after], action, head + text))
            state = after
        if ending:
            for k, name in enumerate(ENDINGS[state][1]):
                out.append((2 * index[-1] + 2 + k, None, name, "insert", CLOSE + render(name)))
            out[-1] = (*out[-1][:4], out[-1][4] + CLOSE)
        columns = [[None if none else conv] * len(out), *zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def repair(turns: DataFrame) -> DataFrame:
    """One row per piece of the repaired conversations: ``conv_id, place, turn, role, action, piece``.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored. Turns are taken in the order of (turn, role, text), nulls first.
    A conversation's pieces in the order of ``place``, put together, are its rendered text. A piece belongs to an input turn, or is an
    inserted empty one (``turn`` null, action ``insert``). ``role`` is the role after repair; an action is keep, relabel, merge or
    merge relabel. A null or unknown role costs a relabel; a null text is empty; rows with a null ``conv_id`` are one conversation; repeated rows are
    turns like others. An empty table gives no rows.
    """
    id_ = F.col("conv_id").cast("long")
    rows = turns.select(
        id_.isNull().alias("none"), F.coalesce(id_, F.lit(0).cast("long")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sort = [F.col(c).asc_nulls_first() for c in ("none", "conv", "turn", "role", "text")]
    ordered = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id())
    kind = "none boolean, conv long, turn long, role string, text string, part int, at long"
    ordered = stored(ordered.mapInArrow(_numbered, kind), "turns")
    # range partitions follow the order: a row's place in its conversation is its place here after all rows of earlier partitions
    counts = ordered.groupBy("none", "conv", "part").count()
    before = "coalesce(sum(count) over (partition by none, conv order by part rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.selectExpr("none", "conv", "part", f"{before} as skipped")
    placed = ordered.join(offsets, ["none", "conv", "part"]).withColumn("index", F.col("at") + F.col("skipped"))
    placed = placed.withColumn("block", F.floor(F.col("index") / BLOCK_TURNS)).drop("part", "at", "skipped")
    roles = placed.select(*KEY, "index", "role").repartition(*KEY).sortWithinPartitions(*KEY, "index")
    costs = roles.mapInArrow(_matrices, "none boolean, conv long, block long, cost array<long>")
    lists = costs.groupBy("none", "conv").agg(F.array_sort(F.collect_list(F.struct("block", "cost"))).alias("parts"))
    ways = stored(lists.mapInArrow(_states, "none boolean, conv long, block long, first int, last int, ending boolean"), "block-states")
    whole = placed.join(ways, list(KEY)).repartition(*KEY).sortWithinPartitions(*KEY, "index")
    return whole.mapInArrow(_rendered, "conv_id long, place long, turn long, role string, action string, piece string")


def conversations(pieces: DataFrame) -> DataFrame:
    """``conv_id, rendered``: the pieces of each conversation put together. For conversations that fit in one value."""
    parts = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("rendered"))
