"""Supervised losses of records with alternative views, readout alignment and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import COSINE_EPS, HEAD_WIDTH, SCOPE_ALL
from assayer.functions.scoring import mode_index, score
from assayer.functions.vectors import dot


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; each norm is at least a small constant."""
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(COSINE_EPS))
    return 1 - dot(a, b) / (norm(a) * norm(b))


def mean_distance(a: Column, b: Column) -> Column:
    """Mean cosine distance over matching readouts."""
    d = F.zip_with(a, b, cosine_distance)
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)


def readout_alignment(a: Column, b: Column) -> Column:
    """Half the mean distance of the candidate readouts plus half that of the global readout.

    Both are ARRAY<ARRAY<DOUBLE>> of one row per candidate followed by the global row.
    """
    d = F.zip_with(a, b, cosine_distance)
    k = F.size(d) - 1
    candidates = F.aggregate(F.slice(d, 1, k), F.lit(0.0), lambda s, x: s + x) / k
    value = 0.5 * candidates + 0.5 * F.element_at(d, -1)
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error("readouts must have one row per outcome plus one").cast("double")
    )


def selected_views(views: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """The one view of each record that a loss uses: named by ``chosen`` (id, view_id), or the only
    view. A missing or repeated match, or several views without a name, is an error."""
    if chosen is not None:
        matched = chosen.join(views, ["id", "view_id"], "left")
        counts = matched.groupBy("id", "view_id").agg(F.count("view_index").alias("n"))
    else:
        matched = views
        counts = views.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    keys = [c for c in ("id", "view_id") if c in counts.columns]
    one = F.when(F.col("n") == 1, F.col("n")).otherwise(
        F.raise_error("the chosen view is not there exactly once").cast("long")
    )
    return matched.join(counts.withColumn("n", one), keys).filter(F.col("n") == 1).drop("n")


def paired_losses(
    base: DataFrame, view: DataFrame, *, width: int | None = None
) -> DataFrame:
    """Loss per supervised question: the mean of base and view where the view has the question.

    ``base`` rows carry the target columns, logits and optionally readouts; ``view`` rows carry
    (id, qid, logits, scope[, readouts]). Output adds ``loss``, ``alignment``, ``paired``,
    ``eligible`` and ``skipped``.
    """
    alt = view.select(
        "id", "qid", F.col("logits").alias("view_logits"), "scope",
        *([F.col("readouts").alias("view_readouts")] if "readouts" in view.columns else []),
    )
    scored = score(base, width, prefix="base_").select(*base.columns, "base_nll")
    joined = scored.join(alt, ["id", "qid"], "left")
    paired = F.col("view_logits").isNotNull()
    swapped = joined.withColumns({"base_logits": F.col("logits"), "logits": F.coalesce("view_logits", "logits")})
    both = score(swapped, width, prefix="view_").withColumn("logits", F.col("base_logits"))
    eligible = paired & (F.col("scope") == SCOPE_ALL)
    if "readouts" in base.columns and "readouts" in view.columns:
        aux = F.when(eligible, readout_alignment(F.col("readouts"), F.col("view_readouts")))
    else:
        aux = F.when(
            eligible, F.raise_error("full readouts are required for this scope").cast("double")
        )
    return both.drop("base_logits").withColumns(
        {
            "loss": F.when(paired, (F.col("base_nll") + F.col("view_nll")) / 2).otherwise(
                F.col("base_nll")
            ),
            "alignment": F.coalesce(aux, F.lit(0.0)),
            "paired": paired.cast("int"),
            "eligible": F.coalesce(eligible, F.lit(False)).cast("int"),
            "skipped": (paired & ~F.coalesce(eligible, F.lit(False))).cast("int"),
        }
    )


def record_losses(questions: DataFrame, coefficient: float = 0.01) -> DataFrame:
    """Weighted mean over the questions of each record. Partial aggregation, one shuffle by id."""
    w = F.col("question_weight")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    return (
        questions.groupBy("id", "record_weight")
        .agg(
            mean("loss").alias("decision_loss"), mean("alignment").alias("alignment_loss"),
            F.sum("paired").alias("paired_questions"),
            F.sum("eligible").alias("eligible_questions"),
            F.sum("skipped").alias("scope_skipped_questions"),
        )
        .withColumn("loss", F.col("decision_loss") + coefficient * F.col("alignment_loss"))
    )


def batch_loss(records: DataFrame, by: list[str] = ()) -> DataFrame:
    """Record-weighted mean loss."""
    w = F.col("record_weight")
    return records.groupBy(*by).agg(
        (F.sum(w * F.col("loss")) / F.sum(w)).alias("loss"), F.count(F.lit(1)).alias("records")
    )


def view_consistency(base: DataFrame, view: DataFrame, width: int | None = None) -> DataFrame:
    """Base against view predictions of one question: total variation, agreement and both losses."""
    left = score(base, width, keep_p=True, prefix="base_").withColumnRenamed("p", "p_base")
    left = left.select("id", "qid", "type", "kind", "t", "allowed", "p_base", "base_nll")
    joined = left.join(view.select("id", "qid", "view_id", "method", "logits"), ["id", "qid"])
    both = score(joined, width, keep_p=True, prefix="view_")
    gap = F.zip_with("p_base", "p", lambda a, b: F.abs(a - b))
    return both.select(
        "id", "view_id", "qid", "method",
        (F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / 2).alias("total_variation"),
        (mode_index(F.col("p_base")) == mode_index(F.col("p"))).cast("int").alias("argmax_agreement"),
        "base_nll", "view_nll",
    )


def head_logits(readouts: Column, w: Column, candidate: Column, global_readout: Column) -> Column:
    """Logits from stored readouts (candidates, then global) and the head's weight matrices.

    logit_i = w.h_i + (C h_i).(G g) / sqrt(256), where C and G have one row per projected dimension.
    The head is one small model constant, passed as literal columns or a one-row broadcast.
    """
    k = F.size(readouts) - 1
    g = F.element_at(readouts, -1)
    # (C h).(G g) = h.(C^T G g): fold the global side into one vector per question.
    projected = F.transform(global_readout, lambda row: dot(row, g))
    folded = F.aggregate(
        F.zip_with(candidate, projected, lambda row, x: F.transform(row, lambda v: v * x)),
        F.transform(w, lambda v: v * 0.0),
        lambda s, v: F.zip_with(s, v, lambda a, b: a + b),
    )
    scale = float(HEAD_WIDTH) ** 0.5
    weights = F.zip_with(w, folded, lambda a, b: a + b / scale)
    return F.transform(F.slice(readouts, 1, k), lambda h: dot(h, weights))


def zero_global(readouts: Column) -> Column:
    """The same readouts with the global row set to zero."""
    k = F.size(readouts) - 1
    zero = F.transform(F.element_at(readouts, -1), lambda v: v * 0.0)
    return F.concat(F.slice(readouts, 1, k), F.array(zero))


def global_ablation(rows: DataFrame, full: str, without: str, target: str, weight: str | None = None) -> DataFrame:
    """One row: weighted mean loss of the logits, of those without the global readout, and how many questions the global readout helps. ``target`` is the
    index of the right outcome."""

    def nll(logits: str) -> Column:
        z = F.col(logits)
        top = F.array_max(z)
        return top + F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))) - F.get(z, F.col(target).cast("int"))

    w = F.col(weight) if weight else F.lit(1.0)
    both = rows.select(w.alias("w"), nll(full).alias("nll"), nll(without).alias("zero_g_nll"))
    return both.agg(
        F.count(F.lit(1)).alias("questions"), (F.sum(F.col("w") * F.col("nll")) / F.sum("w")).alias("nll"),
        (F.sum(F.col("w") * F.col("zero_g_nll")) / F.sum("w")).alias("zero_g_nll"), F.count_if(F.col("nll") < F.col("zero_g_nll")).alias("helped"),
    )
