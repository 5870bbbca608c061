"""Interval labels of a forest of runs, and what a run inherits, without the closure.

Every run gets the places where a walk around its tree enters and leaves it. Then "is an ancestor of" is a range test, and a sum over all ancestors is a
running sum over the walk. The walk is a linked list of two arcs per run, numbered by list ranking. Tasks of neighbouring runs follow the arcs as far as they stay
inside; only arcs that another task points at are ranked by joins, where each jumps twice as far every round. Arcs that never reach the end of a walk belong to
runs whose history runs into a loop.

Stored tables are far larger in memory than on disk, so no join here leaves it to the size of the files whether a side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.prefix import hash_bucket, hash_order, running_sums
from assayer.session import package_path, stored, task_count

SPAN = 1 << 20  # places of a walk that one task sums
ARCS_PER_TASK = 400_000
OPEN, DONE, LOOP = range(3)  # an arc's jump ends at another task's arc, at the end of the walk, nowhere


def parents(runs: DataFrame) -> DataFrame:
    """(run, parent) of ``runs(run, parent, self_contained)``: a self-contained run needs no parent. Parents that are no runs themselves are added; a run that
    repeats with different parents is an error."""
    own = F.when(~F.coalesce(F.col("self_contained"), F.lit(False)), F.col("parent"))
    once = F.when(F.count_distinct(F.coalesce(own.cast("string"), F.lit(""))) > 1, F.raise_error("a run has two parents").cast(runs.schema["run"].dataType))
    known = runs.where(F.col("run").isNotNull()).groupBy("run").agg(once.otherwise(F.max(own)).alias("parent"))
    missing = known.where("parent is not null").select(F.col("parent").alias("run")).distinct().hint("merge").join(known, "run", "left_anti")
    return known.unionByName(missing.withColumn("parent", F.lit(None).cast(known.schema["parent"].dataType)))


def _siblings(nodes: DataFrame) -> DataFrame:
    """(run, following, child): the next child of the same parent in the order of a hash, so that the children of one parent are spread over tasks, and
    the first child of a run."""
    buckets = task_count(nodes.sparkSession)
    rows = nodes.where("parent is not null").withColumn("h", hash_order(F.col("run").cast("string")))
    rows = rows.withColumn("bucket", hash_bucket(F.col("h"), buckets))
    inside = Window.partitionBy("parent", "bucket").orderBy("h", "run")
    chained = stored(rows.withColumn("following", F.lead("run").over(inside)), "siblings")
    heads = chained.groupBy("parent", "bucket").agg(F.min_by("run", F.struct("h", "run")).alias("head"))
    jump = heads.withColumn("after", F.lead("head").over(Window.partitionBy("parent").orderBy("bucket")))  # at most one row per bucket
    linked = chained.hint("merge").join(jump, ["parent", "bucket"]).select("run", F.coalesce("following", "after").alias("following"))
    first = heads.groupBy("parent").agg(F.min_by("head", "bucket").alias("child"))
    return linked.hint("merge").join(first.withColumnRenamed("parent", "run"), "run", "full")


def interval_labels(runs: DataFrame) -> DataFrame:
    """(run, tree, enter, leave, cyclic) for every run and every parent of one. ``tree`` is the root; a is an ancestor of b, or b itself, when both have the same tree and
    a.enter <= b.enter <= a.leave. A run whose history loops is ``cyclic`` and has no labels."""
    nodes = stored(parents(runs), "lineage-nodes")
    links = nodes.hint("merge").join(_siblings(nodes), "run", "left")
    kind = nodes.schema["run"].dataType
    arc = lambda run, up: F.struct(run.cast(kind).alias("run"), F.lit(up).alias("up"))
    run, parent, child, following = (F.col(c) for c in ("run", "parent", "child", "following"))
    down = F.struct(arc(run, False).alias("arc"), F.when(child.isNotNull(), arc(child, False)).otherwise(arc(run, True)).alias("next"), F.lit(1).cast("long").alias("dist"))
    after = F.when(parent.isNull(), arc(run, True)).when(following.isNotNull(), arc(following, False)).otherwise(arc(parent, True))
    up = F.struct(arc(run, True).alias("arc"), after.alias("next"), F.when(parent.isNull(), 0).otherwise(1).cast("long").alias("dist"))
    arcs = links.select(F.inline(F.array(down, up)))
    arcs = arcs.select("arc.run", "arc.up", F.col("next.run").alias("next_run"), F.col("next.up").alias("next_up"), "dist")
    tasks = max(task_count(runs.sparkSession), -(-2 * nodes.count() // ARCS_PER_TASK))
    package_path(runs.sparkSession)
    near = arcs.repartitionByRange(tasks, "run").mapInArrow(_followed, f"{_arc_type(kind)}, dist long, state int")
    near = stored(near, "arcs")
    # only arcs that another task points at take part in the joins
    aims = near.where(F.col("state") == OPEN).select(F.col("next_run").alias("run"), F.col("next_up").alias("up")).distinct()
    entries = stored(near.hint("merge").join(aims, ["run", "up"], "left_semi"), "entries")
    rest = entries.where(F.col("state") == OPEN)
    left, limit = rest.count(), entries.count()
    reach = 1
    while left and reach <= limit:
        entries = stored(entries.where(F.col("state") != OPEN).unionByName(_jumped(rest, entries)), "entries")
        rest = entries.where(F.col("state") == OPEN)
        left = rest.count()
        reach *= 2
    far = near.where(F.col("state") != OPEN).unionByName(_jumped(near.where(F.col("state") == OPEN), entries))
    done = F.col("state") == DONE
    place = far.groupBy("run").agg(
        F.max(F.when(done, F.col("next_run"))).alias("tree"), F.max(F.when(done & ~F.col("up"), -F.col("dist"))).alias("enter"),
        F.max(F.when(done & F.col("up"), -F.col("dist"))).alias("leave"), F.max(~done).alias("cyclic"),
    )
    clear = lambda c: F.when(~F.col("cyclic"), F.col(c)).alias(c)
    return stored(place.select("run", clear("tree"), clear("enter"), clear("leave"), "cyclic"), "lineage")


def _arc_type(kind) -> str:
    return f"run {kind.simpleString()}, up boolean, next_run {kind.simpleString()}, next_up boolean"


def _jumped(arcs: DataFrame, onto: DataFrame) -> DataFrame:
    """``arcs`` moved on by the jump of the arc they end at."""
    target = onto.select(F.col("run").alias("next_run"), F.col("up").alias("next_up"), F.col("next_run").alias("far_run"), F.col("next_up").alias("far_up"), F.col("dist").alias("more"), F.col("state").alias("ends"))
    moved = arcs.hint("merge").join(target, ["next_run", "next_up"])
    return moved.select("run", "up", F.col("far_run").alias("next_run"), F.col("far_up").alias("next_up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ends").alias("state"))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arcs of one task, each moved on to the first arc outside the task or to the end of the walk (an arc of no length)."""
    batches = list(batches)
    if not batches:
        return
    arcs = pa.Table.from_batches(batches).combine_chunks()
    up, next_up = (arcs[c].to_numpy() for c in ("up", "next_up"))
    names = pc.unique(arcs["run"])
    number = pc.index_in(arcs["run"], names).to_numpy() * 2 + up
    place = np.full(2 * len(names), -1)
    place[number] = np.arange(len(number))
    known = pc.index_in(arcs["next_run"], names)
    at = place[known.fill_null(0).to_numpy() * 2 + next_up]
    inside = known.is_valid().to_numpy() & (at >= 0)
    ends = arcs["dist"].to_numpy() == 0
    stays = ends | ~inside
    jump = np.where(stays, np.arange(len(at)), at)
    dist = np.where(stays, 0, 1).astype(np.int64)
    for _ in range(len(at).bit_length()):
        dist, jump = dist + dist[jump], jump[jump]
    state = np.where(ends[jump], DONE, np.where(stays[jump], OPEN, LOOP)).astype(np.int32)
    last = pa.array(jump)
    columns = [arcs["run"], arcs["up"], arcs["next_run"].take(last), arcs["next_up"].take(last), pa.array(dist + (state == OPEN)), pa.array(state)]
    yield from pa.Table.from_arrays(columns, ["run", "up", "next_run", "next_up", "dist", "state"]).to_batches(10_000)


def ancestor_sums(labels: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """(run, ``columns``): each summed over a run and all its ancestors, as a running sum over the walk. ``weights`` has at most one row per run; runs without one
    count 0. Cyclic runs have NULL sums. A large tree is summed in stretches of SPAN places."""
    rows = labels.hint("merge").join(weights, "run", "left").select("run", "tree", "enter", "leave", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])
    signed = lambda place, sign: F.struct(F.col(place).alias("place"), *[(sign * F.col(c)).alias(c) for c in columns])
    events = rows.where("enter is not null").select("run", "tree", F.posexplode(F.array(signed("enter", 1), signed("leave", -1))).alias("side", "e")).select("run", "tree", "side", "e.*")
    events = stored(events.withColumn("bucket", F.floor(F.col("place") / SPAN)), "walk")
    summed = running_sums(events, [F.col("place"), F.col("side")], columns, ["tree"])
    found = summed.where("side = 0").select("run", *[F.col(f"cum_{c}").alias(c) for c in columns])
    return labels.select("run").hint("merge").join(found, "run", "left")


def _cover(enter: Column, leave: Column) -> Column:
    """The dyadic stretches that make up a range: ARRAY<STRUCT<level, part>>, at most two per level."""
    kind = "array<struct<level:int,part:long>>"
    start = F.struct(enter.alias("lo"), leave.alias("hi"), F.array().cast(kind).alias("out"))
    one = lambda level, part: F.array(F.struct(level.cast("int").alias("level"), part.alias("part")))

    def step(s: Column, level: Column) -> Column:
        on = s["lo"] <= s["hi"]
        odd, even = on & (s["lo"] % 2 == 1), on & (s["hi"] % 2 == 0)
        none = F.array().cast(kind)
        right = F.when(even & ~(odd & (s["lo"] == s["hi"])), one(level, s["hi"])).otherwise(none)
        out = F.concat(s["out"], F.when(odd, one(level, s["lo"])).otherwise(none), right)
        lo, hi = F.when(odd, s["lo"] + 1).otherwise(s["lo"]), F.when(even, s["hi"] - 1).otherwise(s["hi"])
        return F.struct(
            F.when(on & (lo <= hi), F.shiftright(lo, 1)).otherwise(F.lit(1).cast("long")).alias("lo"),
            F.when(on & (lo <= hi), F.shiftright(hi, 1)).otherwise(F.lit(0).cast("long")).alias("hi"), out.alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda s: s["out"])


def _under(asked: DataFrame, labels: DataFrame, ranges: DataFrame) -> DataFrame:
    """(run, and the columns of ``ranges(tree, enter, leave, ...)`` besides these) for the runs in ``asked(run)`` and every range their place lies in; nothing for runs
    without labels. A range is cut into dyadic stretches and a place lies in one stretch per level, so the range test is an equality join. A cyclic run that is asked
    for is an error."""
    wanted = stored(labels.hint("merge").join(asked.select("run").distinct(), "run", "left_semi"), "asked")  # so that only loops asked for fail
    deepest = labels.agg(F.min("enter")).first()[0]
    base = -(deepest or 0)  # places count from 0 here
    bits = max(1, base.bit_length())
    loop = F.raise_error("the history of a run is a loop").cast(labels.schema["tree"].dataType)
    tree = F.when(~F.col("cyclic"), F.col("tree")).otherwise(loop).alias("tree")
    points = wanted.select("run", tree, (F.col("enter") + base).alias("place"), F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level"))
    points = points.select("run", "tree", "level", F.expr("shiftright(place, level)").alias("part"))
    more = [c for c in ranges.columns if c not in ("tree", "enter", "leave")]
    stretches = ranges.select(*more, "tree", F.inline(_cover(F.col("enter") + base, F.col("leave") + base)))
    return points.hint("merge").join(stretches, ["tree", "level", "part"]).select("run", *more)


def ancestors_of(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """(run, ancestor) for the runs in ``asked(run)``, themselves included, and nothing for other runs. A cyclic run that is asked for is an error."""
    return _under(asked, labels, labels.where("enter is not null").select(F.col("run").alias("ancestor"), "tree", "enter", "leave"))


def inherited_sources(asked: DataFrame, labels: DataFrame, sources: DataFrame) -> DataFrame:
    """All sources of the asked runs and their ancestors, each once per run. Of the runs that hold a source, those below another holder add nothing; the ranges of the
    others do not overlap, so the join makes the rows of the result and no more."""
    columns = [c for c in sources.columns if c != "run"]
    held = sources.select("run", F.struct(*columns).alias("source")).distinct()
    held = labels.where("enter is not null").select("run", "tree", "enter", "leave").hint("merge").join(held, "run")
    side = lambda place, sign: F.struct(F.col(place).alias("place"), F.lit(sign).cast("long").alias("open"))
    events = held.select("tree", "source", "enter", "leave", F.posexplode(F.array(side("enter", 1), side("leave", -1))).alias("side", "e")).select("tree", "source", "enter", "leave", "side", "e.*")
    events = stored(events.withColumn("bucket", F.floor(F.col("place") / SPAN)), "holders")
    summed = running_sums(events, [F.col("place")], ["open"], ["tree", "source"])
    highest = summed.where("side = 0 and cum_open = 1").select("tree", "enter", "leave", "source")
    return _under(asked, labels, highest).select("run", "source.*")


def _held_in_loops(labels: DataFrame, runs: DataFrame, held: DataFrame) -> DataFrame:
    """(run, n): how many of the ``held`` runs the history of each cyclic run holds, as 0 or more than 0. Every round looks twice as far up."""
    cyclic = labels.where("cyclic").select("run")
    up = parents(runs).hint("merge").join(cyclic, "run").select("run", F.col("parent").alias("far"))
    up = stored(up.hint("merge").join(held, "run", "left").select("run", "far", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "loops")
    reach, limit = 1, up.count()
    while reach <= limit:
        above = up.select(F.col("run").alias("far"), F.col("far").alias("next"), F.col("n").alias("more"))
        up = stored(up.hint("merge").join(above, "far").select("run", F.col("next").alias("far"), F.greatest("n", "more").alias("n")), "loops")
        reach *= 2
    return up.select("run", "n")


def incomplete_runs(labels: DataFrame, runs: DataFrame, sources: DataFrame, split: str) -> DataFrame:
    """(run, cyclic, sourced): runs whose history holds no source of ``split``, and those whose history loops, with whether it holds one all the same."""
    held = sources.where(F.col("split") == split).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    sums = ancestor_sums(labels, held, ["n"]).where("n is not null").unionByName(_held_in_loops(labels, runs, held))
    found = labels.select("run", "cyclic").hint("merge").join(sums, "run")
    return found.where(F.col("cyclic") | (F.col("n") == 0)).select("run", "cyclic", (F.col("n") > 0).alias("sourced"))
