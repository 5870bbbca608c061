"""Split leakage, provenance of runs and joins between record sets.

Sources are long tables ``(run, split, sha256, path, key_kind, key)`` with ``key_kind`` "split_group"
or "record_id"; nothing is collected into lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import TOKEN_COLUMNS
from assayer.functions import json as J
from assayer.session import shared_dir


def keys_of(records: DataFrame, *carry: str) -> DataFrame:
    """One row per key of a record: its split group and its id."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("key_kind"), F.col(c).alias("key"))
    return records.select(
        *carry, F.inline(F.array(pair("split_group", "split_group"), pair("record_id", "id")))
    )


def membership(records: DataFrame) -> DataFrame:
    """Distinct groups and ids as a long table."""
    return keys_of(records).distinct()


def split_leakage(records: DataFrame) -> DataFrame:
    """Keys that occur in more than one split. Partial min/max collapse hot groups map-side."""
    return (
        keys_of(records, "split")
        .groupBy("key_kind", "key")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"),
             F.count(F.lit(1)).alias("n"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def group_gate(records: DataFrame, *, allow_inferred: bool = False) -> DataFrame:
    """Records without an audited split group."""
    missing = F.coalesce(F.col("split_group"), F.lit("")) == ""
    inferred = F.coalesce(F.col("split_group_inferred"), F.lit(False))
    reason = F.when(missing, "missing")
    if not allow_inferred:
        reason = reason.when(inferred, "inferred")
    return records.select("id", reason.alias("reason")).filter(missing | (inferred & F.lit(not allow_inferred)))


def check_splits(records: DataFrame) -> None:
    """Raise on a repeated id, a missing group or a key in two splits. Reads at most one bad row."""
    for problem, rows in (
        ("an id repeats", duplicate_ids(records)),
        ("a record has no audited group", group_gate(records, allow_inferred=True)),
        ("a key occurs in two splits", split_leakage(records)),
    ):
        bad = rows.head(1)
        if bad:
            raise ValueError(f"{problem}: {bad[0].asDict()}")


def source_overlap(candidate: DataFrame, sources: DataFrame, split: str) -> DataFrame:
    """Keys of a candidate that prior data of another split already holds."""
    others = (
        sources.filter(F.col("split") != split)
        .groupBy("key_kind", "key")
        .agg(F.min("split").alias("prior_split"), F.min("path").alias("path"))
    )
    return candidate.join(others, ["key_kind", "key"])


def independence(
    records: DataFrame, sources: DataFrame, purpose: str, calibration_groups: DataFrame | None = None
) -> DataFrame:
    """Overlap of evaluation or calibration records with everything used for another purpose."""
    allowed = "test" if purpose == "evaluation" else "calibration"
    if calibration_groups is not None:
        sources = sources.select("split", "path", "key_kind", "key").unionByName(
            calibration_groups.select(
                F.lit("calibration").alias("split"), F.lit("temperature file").alias("path"),
                F.lit("split_group").alias("key_kind"), F.col("split_group").alias("key"),
            )
        )
    return source_overlap(membership(records), sources, allowed)


def course_conflicts(current: DataFrame, inherited: DataFrame) -> DataFrame:
    """Keys whose split changed between an earlier course and this one."""
    old = inherited.select("key_kind", "key", F.col("split").alias("prior_split")).distinct()
    return (
        current.select("key_kind", "key", "split").distinct()
        .join(old, ["key_kind", "key"])
        .filter(F.col("split") != F.col("prior_split"))
    )


def merge_courses(inherited: DataFrame, current: DataFrame) -> DataFrame:
    """Union of source headers (split, sha256, ord, ...); the last one per (split, sha256) wins."""
    both = inherited.unionByName(current)
    carried = [c for c in both.columns if c not in ("split", "sha256")]
    return (
        both.groupBy("split", "sha256")
        .agg(F.max_by(F.struct(*carried), "ord").alias("s"))
        .select("split", "sha256", "s.*")
    )


def ancestors(runs: DataFrame) -> DataFrame:
    """Closure (run, ancestor, depth, cyclic) over ``runs(run, parent, self_contained)``.

    A run is its own ancestor at depth 0; a self-contained run needs no parent. Each round doubles
    the known distance, so a chain of n runs takes log2(n) joins. Every round is checkpointed in the
    shared folder, which cuts the lineage and survives lost executors.
    """
    shared_dir(runs.sparkSession)
    edges = runs.filter(F.col("parent").isNotNull() & ~F.col("self_contained")).select(
        F.col("run").alias("src"), F.col("parent").alias("dst")
    )
    jumps = edges.withColumn("d", F.lit(1)).checkpoint()
    pairs = jumps
    reach = 1
    while True:  # ends when no new pair appears, in a cycle too
        # pairs: every ancestor up to distance ``reach``; jumps: exactly ``reach``.
        further = (
            pairs.join(jumps.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("d").alias("e")),
                       F.col("dst") == F.col("mid"))
            .select("src", F.col("far").alias("dst"), (F.col("d") + F.col("e")).alias("d"))
            .filter(F.col("d") > reach)
        )
        new = further.groupBy("src", "dst").agg(F.min("d").alias("d")).join(
            pairs.select("src", "dst"), ["src", "dst"], "left_anti"
        ).checkpoint()
        if new.isEmpty():
            break
        pairs = pairs.unionByName(new).checkpoint()
        jumps = (
            jumps.join(jumps.select(F.col("src").alias("mid"), F.col("dst").alias("far")), F.col("dst") == F.col("mid"))
            .select("src", F.col("far").alias("dst"), F.lit(2 * reach).alias("d"))
            .checkpoint()
        )
        reach *= 2
    loops = pairs.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("dst")).distinct()
    cyclic = pairs.join(loops, "dst", "left_semi").select("src").unionByName(
        loops.select(F.col("dst").alias("src"))
    ).distinct().withColumn("cyclic", F.lit(True))
    own = runs.select(F.col("run").alias("src"), F.col("run").alias("dst"), F.lit(0).alias("d"))
    every = own.unionByName(pairs.filter(F.col("src") != F.col("dst")).select("src", "dst", "d"))
    return every.join(cyclic, "src", "left").select(
        F.col("src").alias("run"), F.col("dst").alias("ancestor"), F.col("d").alias("depth"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )


def comparable(text: Column) -> Column:
    """Canonical record text without views, token columns and the training-use note."""
    drop = ("views", *TOKEN_COLUMNS, "_token_settings")
    kept = F.filter(J.entries(text), lambda e: ~e["key"].isin(*drop))
    note = F.transform(
        kept,
        lambda e: F.when(
            e["key"] == "metadata",
            J.let(
                F.filter(J.entries(e["json"]), lambda m: m["key"] != "training_use"),
                lambda m: J.object_from(F.transform(m, lambda x: x["key"]), F.transform(m, lambda x: x["json"])),
            ),
        ).otherwise(e["json"]),
    )
    return J.canonical(J.object_from(F.transform(kept, lambda e: e["key"]), note))


def pair_differences(records: DataFrame, view_set: DataFrame, text: str = "record_json") -> DataFrame:
    """Ids whose two copies differ beyond their views."""
    digest = F.sha2(comparable(F.col(text)), 256)
    left = records.select("id", digest.alias("a"))
    right = view_set.select("id", digest.alias("b"))
    return left.join(right, "id").filter(F.col("a") != F.col("b")).select("id")


def attach_views(records: DataFrame, view_set: DataFrame) -> DataFrame:
    """Views of the same id replace those of the record; view records without a match are added
    once. An id that repeats in the view set is an error. Both sides share their columns; ``views`` decides what is replaced."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error("a view set repeats an id").cast(view_set.schema["views"].dataType))
    views = view_set.groupBy("id").agg(once.otherwise(F.any_value("views")).alias("__views"))
    joined = records.join(views, "id", "left").withColumn(
        "views", F.coalesce("__views", "views")
    ).drop("__views")
    extra = view_set.join(records.select("id"), "id", "left_anti")
    return joined.unionByName(extra.select(*joined.columns))


def view_set_problems(view_set: DataFrame) -> DataFrame:
    """Repeated ids and records without an eligible view (column ``eligible``)."""
    per_id = view_set.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("eligible").alias("eligible"))
    return per_id.select(
        "id", F.when(F.col("n") > 1, "duplicate").when(F.col("eligible") < 1, "no_view").alias("problem")
    ).filter((F.col("n") > 1) | (F.col("eligible") < 1))
