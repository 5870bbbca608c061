"""Update plans over a dataset: shuffled order, token budgets, packs, batches and rank shares.

The greedy rule of the planner is sequential, but where a batch ends depends only on where it starts.
Blocks of the shuffled order therefore report, for every possible first start, where they hand over
and how many batches they close. Composing those small tables gives each block its true start, so
the plan equals the one-by-one rule while all costs are read in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.buckets import bit_length
from assayer.operators.prefix import global_order, hash_order

BLOCK_ROWS = 500_000
BLOCKS_PER_GROUP = 1_000


def epoch_order(records: DataFrame, seed: int, epochs: int = 1, key: str = "id") -> DataFrame:
    """Add ``epoch`` and ``ord``: a seeded permutation per epoch, the same on any partitioning."""
    rows = records.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = hash_order(F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string"))
    return global_order(rows.withColumn("__h", order), "__h", [key], ["epoch"]).drop("__h")


def batch_ends(costs: np.ndarray, limit: int, budget: int) -> np.ndarray:
    """For every start, where the next batch starts: at most ``limit`` records and ``budget``
    tokens, and at least one record."""
    n = len(costs)
    before = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)])
    start = np.arange(n)
    by_budget = np.searchsorted(before, before[:-1] + budget, side="right") - 1
    return np.maximum(start + 1, np.minimum(start + limit, by_budget))


def _with_halo(ordered: DataFrame, limit: int, block_rows: int) -> DataFrame:
    """Rows with their block, plus the first ``limit`` rows of the next block."""
    block = F.floor(F.col("ord") / block_rows).cast("long")
    head = (F.col("ord") % block_rows < limit) & (block > 0)
    blocks = F.when(head, F.array(block - 1, block)).otherwise(F.array(block))
    return ordered.withColumn("block", F.explode(blocks))


def _block_table(pdf: pd.DataFrame, limit: int, budget: int, block_rows: int) -> pd.DataFrame:
    pdf = pdf.sort_values("ord")
    block = int(pdf["block"].iloc[0])
    first = block * block_rows
    size = int((pdf["ord"] < first + block_rows).sum())
    ends = batch_ends(pdf["cost"].to_numpy(np.int64), limit, budget)[:size]
    # Pointer doubling: follow batch ends until the block is left, counting batches.
    goal = np.concatenate([np.minimum(ends, size), [size]])
    leave = np.concatenate([ends, [size]])
    count = np.concatenate([np.ones(size, np.int64), [0]])
    exact = np.where(goal < size, -1, leave)
    while (exact[:size] < 0).any():
        open_rows = exact < 0
        target = goal[open_rows]
        exact_next = exact[target]
        count[open_rows] += count[target]
        exact[open_rows] = exact_next
        goal[open_rows] = goal[target]
    entry = np.arange(min(limit, size))
    return pd.DataFrame(
        {
            "epoch": pdf["epoch"].iloc[0], "block": block, "entry": entry,
            "exit": exact[entry] - size, "batches": count[entry],
        }
    )


TABLE = "epoch int, block long, entry long, exit long, batches long"


def _compose(pdf: pd.DataFrame, group: str) -> pd.DataFrame:
    """Hand-over table of consecutive blocks joined into one."""
    steps = [dict(zip(g["entry"], zip(g["exit"], g["batches"]))) for _b, g in pdf.sort_values("block").groupby("block")]
    rows = []
    for entry in sorted(steps[0]):
        at, total = entry, 0
        for step in steps:
            at, n = step.get(at, (0, 0))
            total += n
        rows.append((pdf["epoch"].iloc[0], pdf[group].iloc[0], entry, at, total))
    return pd.DataFrame(rows, columns=["epoch", group, "entry", "exit", "batches"])


def _starts(pdf: pd.DataFrame, entry: int, before: int, group: str) -> pd.DataFrame:
    """True entry and earlier batches of each block, given those of the first."""
    rows = []
    for block, g in pdf.sort_values(group).groupby(group):
        rows.append((pdf["epoch"].iloc[0], block, entry, before))
        step = dict(zip(g["entry"], zip(g["exit"], g["batches"])))
        entry, n = step.get(entry, (0, 0))
        before += n
    return pd.DataFrame(rows, columns=["epoch", group, "start", "before"])


def _block_starts(table: DataFrame, per_group: int) -> DataFrame:
    """(epoch, block, start, before) from the hand-over tables, in two levels. The top level holds
    blocks / per_group tables of at most ``limit`` rows each."""
    grouped = table.withColumn("group", F.floor(F.col("block") / per_group).cast("long"))
    top = grouped.groupBy("epoch", "group").applyInPandas(
        lambda pdf: _compose(pdf, "group"), "epoch int, group long, entry long, exit long, batches long"
    )
    group_start = top.groupBy("epoch").applyInPandas(
        lambda pdf: _starts(pdf, 0, 0, "group"), "epoch int, group long, start long, before long"
    )

    def inside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["epoch", "block", "start", "before"])
        return _starts(left, int(right["start"].iloc[0]), int(right["before"].iloc[0]), "block")

    return grouped.groupBy("epoch", "group").cogroup(group_start.groupBy("epoch", "group")).applyInPandas(
        inside, "epoch int, block long, start long, before long"
    )


def plan_updates(
    ordered: DataFrame,
    accumulation_steps: int,
    tokens_per_step: int,
    *,
    max_steps: int | None = None,
    block_rows: int = BLOCK_ROWS,
    blocks_per_group: int = BLOCKS_PER_GROUP,
) -> DataFrame:
    """Update number and position of every record: (epoch, ord, id, cost, update, pos).

    An update closes when it has ``accumulation_steps`` records or when the next record would exceed
    ``tokens_per_step``; a record above the budget stands alone. Updates are numbered over all epochs.
    """
    limit, budget = accumulation_steps, tokens_per_step
    block_rows = max(block_rows, limit)
    rows = ordered.select("epoch", "ord", "id", F.col("cost").cast("long").alias("cost"))
    id_type = ordered.schema["id"].dataType.simpleString()
    haloed = _with_halo(rows, limit, block_rows)
    table = haloed.select("epoch", "block", "ord", "cost").groupBy("epoch", "block").applyInPandas(
        lambda pdf: _block_table(pdf, limit, budget, block_rows), TABLE
    )
    starts = _block_starts(table, blocks_per_group)
    batches = table.join(starts, ["epoch", "block"]).filter(F.col("entry") == F.col("start"))
    per_epoch = batches.groupBy("epoch").agg(F.sum("batches").alias("n"))
    earlier = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_epoch.select("epoch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("epoch_offset"))

    def number(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["epoch", "ord", "id", "cost", "update", "pos"]
        if left.empty:
            return pd.DataFrame(columns=columns)
        left = left.sort_values("ord")
        block = int(left["block"].iloc[0])
        first = block * block_rows
        ords = left["ord"].to_numpy(np.int64)
        size = int((ords < first + block_rows).sum())
        ends = batch_ends(left["cost"].to_numpy(np.int64), limit, budget)
        at, update = int(right["start"].iloc[0]), int(right["before"].iloc[0])
        batch_no, position = [], []
        taken = []
        while at < size:
            stop = min(int(ends[at]), len(ords))
            taken.append(np.arange(at, stop))
            batch_no.append(np.full(stop - at, update))
            position.append(np.arange(stop - at))
            at, update = stop, update + 1
        if not taken:
            return pd.DataFrame(columns=columns)
        take = np.concatenate(taken)
        return pd.DataFrame(
            {"epoch": left["epoch"].iloc[0], "ord": ords[take], "id": left["id"].to_numpy()[take],
             "cost": left["cost"].to_numpy()[take], "update": np.concatenate(batch_no),
             "pos": np.concatenate(position)}
        )

    numbered = haloed.groupBy("epoch", "block").cogroup(starts.groupBy("epoch", "block")).applyInPandas(
        number, f"epoch int, ord long, id {id_type}, cost long, update long, pos int"
    )
    plan = (
        numbered.join(F.broadcast(offsets), "epoch")
        .withColumn("update", F.col("update") + F.col("epoch_offset"))
        .drop("epoch_offset")
    )
    return plan if max_steps is None else plan.filter(F.col("update") < max_steps)


def greedy_groups(items: Column, opens, carried: list[tuple]) -> Column:
    """Group numbers of a bounded, ordered array of structs with integer fields.

    ``carried`` names the long values kept for the open group as (name, first, merge);
    ``opens(state, x)`` is true when x starts a new group. The result has one number per item.
    """
    triples = carried
    zero = F.struct(
        F.lit(-1).alias("group"), F.lit(0).cast("long").alias("count"),
        *[F.lit(0).cast("long").alias(n) for n, _f, _m in triples],
        F.array().cast("array<int>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        fresh = (s["group"] < 0) | opens(s, x)
        group = F.when(fresh, s["group"] + 1).otherwise(s["group"])
        return F.struct(
            group.alias("group"),
            F.when(fresh, F.lit(1).cast("long")).otherwise(s["count"] + 1).alias("count"),
            *[
                F.when(fresh, first(x).cast("long")).otherwise(merge(s[n], x).cast("long")).alias(n)
                for n, first, merge in triples
            ],
            F.concat(s["out"], F.array(group)).alias("out"),
        )

    return F.aggregate(items, zero, step, lambda s: s["out"])


def _members(plan: DataFrame, by: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """The members of each bounded group as one ordered array."""
    return plan.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *carry))).alias("items"))


def _exploded(groups: DataFrame, by: list[str], name: str, numbers: Column) -> DataFrame:
    pairs = F.arrays_zip(F.col("items"), numbers.alias(name))
    return groups.select(*by, F.posexplode(pairs).alias("pos_in_order", "z")).select(
        *by, "pos_in_order", "z.items.*", F.col(f"z.{name}").alias(name)
    )


def physical_packs(plan: DataFrame, record_batch_size: int, tokens_per_batch: int) -> DataFrame:
    """Greedy packs inside each update (at most ``accumulation_steps`` records, a bounded array)."""
    groups = _members(plan, ["epoch", "update"], ["pos"], ["id", "cost"])
    numbers = greedy_groups(
        F.col("items"), lambda s, x: (s["count"] >= record_batch_size)
        | (s["tokens"] + x["cost"] > tokens_per_batch),
        [("tokens", lambda x: x["cost"], lambda a, x: a + x["cost"])],
    )
    return _exploded(groups.withColumn("pack", numbers), ["epoch", "update"], "pack", F.col("pack"))


def length_buckets(plan: DataFrame, record_batch_size: int, tokens_per_batch: int) -> DataFrame:
    """Batches of similar length inside each update.

    Records carry ``enc`` and ``dec`` (longest state and question), ``states`` and ``questions``
    (counts). They are ordered by the bit lengths of enc and dec; a batch closes at the size limit,
    beyond a twofold ratio, or when the padded token rectangle exceeds the bound.
    """
    keyed = plan.withColumns({"be": bit_length(F.col("enc")), "bd": bit_length(F.col("dec"))})
    groups = _members(keyed, ["epoch", "update"], ["be", "bd", "pos"], ["id", "enc", "dec", "states", "questions"])
    hi = lambda a, b: F.greatest(a, b)
    lo = lambda a, b: F.least(a, b)

    def opens(s: Column, x: Column) -> Column:
        top_e, top_d = hi(s["emax"], x["enc"]), hi(s["dmax"], x["dec"])
        padded = top_e * (s["ns"] + x["states"]) + top_d * (s["nq"] + x["questions"])
        return (
            (s["count"] >= record_batch_size) | (top_e > 2 * lo(s["emin"], x["enc"]))
            | (top_d > 2 * lo(s["dmin"], x["dec"])) | (padded > tokens_per_batch)
        )

    numbers = greedy_groups(
        F.col("items"), opens,
        [
            ("emax", lambda x: x["enc"], lambda a, x: hi(a, x["enc"])),
            ("emin", lambda x: x["enc"], lambda a, x: lo(a, x["enc"])),
            ("dmax", lambda x: x["dec"], lambda a, x: hi(a, x["dec"])),
            ("dmin", lambda x: x["dec"], lambda a, x: lo(a, x["dec"])),
            ("ns", lambda x: x["states"], lambda a, x: a + x["states"]),
            ("nq", lambda x: x["questions"], lambda a, x: a + x["questions"]),
        ],
    )
    return _exploded(groups.withColumn("batch", numbers), ["epoch", "update"], "batch", F.col("batch"))


def question_batches(questions: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """Questions of a request by length: at most ``limit`` per batch and twice the first length.
    A request's questions fit its token budget, which bounds the array."""
    groups = _members(questions, [key], ["length", "q_pos"], ["qid"])
    numbers = greedy_groups(
        F.col("items"), lambda s, x: (s["count"] == limit) | (x["length"] > 2 * s["first"]),
        [("first", lambda x: x["length"], lambda a, x: a)],
    )
    return _exploded(groups.withColumn("batch", numbers), [key], "batch", F.col("batch"))


def assign_ranks(plan: DataFrame, world: int) -> DataFrame:
    """Longest first to the least loaded rank inside each update; ties go to the lowest rank."""
    ranked = plan.withColumn("neg", -F.col("cost"))
    groups = _members(ranked, ["epoch", "update"], ["neg", "pos"], ["id", "cost"])
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), world).alias("loads"), F.array().cast("array<int>").alias("out")
    )

    def step(s: Column, x: Column) -> Column:
        target = (F.array_position(s["loads"], F.array_min(s["loads"])) - 1).cast("int")
        loads = F.transform(s["loads"], lambda v, i: F.when(i == target, v + x["cost"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(s["out"], F.array(target)).alias("out"))

    numbers = F.aggregate("items", zero, step, lambda s: s["out"])
    return _exploded(groups.withColumn("rank", numbers), ["epoch", "update"], "rank", F.col("rank"))


def pack_offsets(packs: DataFrame, by: list[str] = ("epoch", "update", "pack"), order: str = "pos") -> DataFrame:
    """Cumulative start of each record inside its pack, whose length the token budget bounds."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return packs.withColumn("offset", F.sum("cost").over(window) - F.col("cost"))


def sample_view(views: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """One view per record and epoch, chosen by a seeded hash. ``min_by`` combines map-side."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("id").cast("string"), F.col("view_id")))
    carried = [c for c in views.columns if c != "id"]
    return views.groupBy("id").agg(F.min_by(F.struct(*carried), key).alias("v")).select("id", "v.*")


def check_costs(costs: DataFrame, expected: dict, manifest: dict) -> DataFrame:
    """The stored costs when they match their manifest; count and minimum in one pass."""
    wrong = sorted(k for k, v in expected.items() if manifest.get(k) != v)
    if wrong:
        raise ValueError(f"stored costs do not match the dataset, compiler or course: {wrong}")
    row = costs.agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("low"), F.count("cost").alias("given")).first()
    if row["n"] != expected["records"] or row["given"] != row["n"] or (row["low"] or 0) < 1:
        raise ValueError("stored costs are incomplete or below one")
    return costs


def update_statistics(rows: DataFrame, sums: list[str], largest: list[str] = (), seconds: str | None = None) -> DataFrame:
    """Sums and maxima over the ranks of each update, and rates per second when given."""
    out = rows.groupBy("epoch", "update").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(f"max_{c}") for c in largest],
        F.count(F.lit(1)).alias("records"), *([F.max(seconds).alias("seconds")] if seconds else []),
    )
    if not seconds:
        return out
    return out.withColumns({f"{c}_per_second": F.col(c) / F.col("seconds") for c in [*sums, "records"]})
