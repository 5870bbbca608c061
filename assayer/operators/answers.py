"""Logits to typed answers: temperatures, rotations, confidence, usage and shared states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import BOOLEAN, CHOICE, SCORE
from assayer.functions.scoring import mode_index, not_finite, probabilities
from assayer.operators.skew import fan_out_join

# Fixed pattern: a temperature key is a question type with an optional outcome count.
TEMPERATURE_KEY = r"^(choice|noul|score)(:[0-9]*)?$"


def temperature_violations(temperatures: DataFrame) -> DataFrame:
    """Rows of (key, value) that are no usable temperature."""
    count = F.regexp_extract("key", r":([0-9]+)$", 1)
    bad_key = ~F.col("key").rlike(TEMPERATURE_KEY) | (
        (count != "") & (F.expr("try_cast(regexp_extract(key, ':([0-9]+)$', 1) AS DECIMAL(38,0))") < 2)
    )
    value = F.col("value")
    return temperatures.select(
        "key", "value",
        F.when(F.coalesce(bad_key, F.lit(True)), "key")
        .when(value.isNull() | not_finite(value) | (value <= 0), "value")
        .alias("rule"),
    ).filter(F.col("rule").isNotNull())


def with_temperature(df: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Add ``temperature``: the entry for type and outcome count, else the type, else 1.0.

    A repeated key is an error. Keys are types with counts up to 255, so the table has at most a few hundred rows.
    """
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error("a temperature key repeats").cast("double"))
    small = temperatures.groupBy("key").agg(once.otherwise(F.any_value("value").cast("double")).alias("value"))
    exact = small.select(F.col("key").alias("__exact"), F.col("value").alias("__t1"))
    plain = small.select(F.col("key").alias("__plain"), F.col("value").alias("__t2"))
    count = F.size("keys").cast("string")
    return (
        df.withColumns(
            {"__exact": F.concat_ws(":", F.col("type"), count), "__plain": F.col("type")}
        )
        .join(F.broadcast(exact), "__exact", "left")
        .join(F.broadcast(plain), "__plain", "left")
        .withColumn("temperature", F.coalesce("__t1", "__t2", F.lit(1.0)))
        .drop("__exact", "__plain", "__t1", "__t2")
    )


def choice_confidence(p: Column) -> Column:
    k = F.size(p)
    return F.when(k == 1, 1.0).otherwise(
        F.greatest(F.lit(0.0), (F.array_max(p) - 1 / k) / (1 - 1 / F.greatest(k, F.lit(2))))
    )


def expected_level(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)


def score_confidence(p: Column) -> Column:
    """One minus the spread around the mode over the spread of an even distribution."""
    k, mode = F.size(p), mode_index(p)
    spread = F.aggregate(
        F.transform(p, lambda v, i: v * F.abs(i - mode)), F.lit(0.0), lambda s, v: s + v
    )
    even = F.aggregate(
        F.transform(p, lambda v, i: F.abs(i - (k - 1) / 2.0)), F.lit(0.0), lambda s, v: s + v
    ) / k
    return F.greatest(F.lit(0.0), 1 - spread / even)


def typed_answers(df: DataFrame) -> DataFrame:
    """Add the answer columns from ``p`` in outcome order.

    ``noul`` for boolean questions; ``choice``, ``answer_probabilities`` and ``confidence`` for
    choices; ``score``, ``legend`` and ``confidence`` for scores.
    """
    p, keys, kind = F.col("p"), F.col("keys"), F.col("type")
    columns = {
        BOOLEAN: F.when(kind == BOOLEAN, F.get(p, F.lit(0))),
        CHOICE: F.when(kind == CHOICE, F.get(keys, mode_index(p))),
        SCORE: F.when(kind == SCORE, expected_level(p)),
        "answer_probabilities": F.when(kind != BOOLEAN, F.map_from_arrays(keys, p)),
        "confidence": F.when(kind == CHOICE, choice_confidence(p)).when(
            kind == SCORE, score_confidence(p)
        ),
    }
    if "descriptions" in df.columns:
        columns["legend"] = F.when(kind == SCORE, F.map_from_arrays(keys, F.col("descriptions")))
    return df.withColumns(columns)


def answers(predictions: DataFrame, temperatures: DataFrame | None = None) -> DataFrame:
    """Typed answers of a predictions table with ``type``, ``keys`` and ``logits``."""
    df = predictions
    if temperatures is not None:
        df = with_temperature(df, temperatures)
    elif "temperature" not in df.columns:
        df = df.withColumn("temperature", F.lit(1.0))
    usable = (F.size("logits") == F.size("keys")) & ~F.exists("logits", not_finite)
    logits = F.when(usable, F.col("logits")).otherwise(
        F.raise_error("expected finite logits for every outcome").cast("array<double>")
    )
    return typed_answers(df.withColumn("p", probabilities(logits, F.col("temperature"))))


def rotation_variants(questions: DataFrame, *, names: str | None = None) -> DataFrame:
    """Each multi-option choice in every cyclic order, as extra rows with ``rotation`` > 0.

    ``names`` is an array column of all question ids of the request; a variant name that exists
    there gets further ``#`` signs.
    """
    k = F.size("keys")
    turns = F.when((F.col("type") == CHOICE) & (k > 1), k - 1).otherwise(0)
    df = questions.withColumn("rotation", F.explode(F.sequence(F.lit(0), turns)))
    r = F.col("rotation")

    def turn(c: Column) -> Column:
        return F.when(r == 0, c).otherwise(
            F.concat(F.slice(c, r + 1, F.size(c) - r), F.slice(c, F.lit(1), r))
        )

    variant = F.concat(F.col("qid"), F.lit("#rotation"), r.cast("string"))
    if names is not None:
        # The longest run of '#' behind this name among the request's own ids decides.
        taken = F.filter(F.col(names), lambda n: n.rlike(r"#rotation[0-9]+#*$"))
        free = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size(taken)),
                lambda i: F.concat(variant, F.repeat(F.lit("#"), i)),
            ),
            lambda n: ~F.array_contains(F.col(names), n),
        )
        variant = F.get(free, F.lit(0))
    columns = {"variant": F.when(r == 0, F.col("qid")).otherwise(variant), "keys": turn(F.col("keys"))}
    if "descriptions" in questions.columns:
        columns["descriptions"] = turn(F.col("descriptions"))
    return df.withColumns(columns)


def rotation_average(variants: DataFrame, keys: list[str] = ("id", "qid")) -> DataFrame:
    """Mean probability per option over all rotations, in the order of the unrotated question.

    Each variant is turned back inside its row, so a question of K options sends K rows. At most 255 of them, with at most 255 numbers each, meet in one group.
    """
    r, k = F.col("rotation"), F.size("p")
    back = F.concat(F.slice("p", k - r + 1, r), F.slice("p", F.lit(1), k - r))
    turned = variants.select(*keys, "type", "rotation", F.col("keys").alias("__order"), F.when(r > 0, back).otherwise(F.col("p")).alias("__p"))
    met = turned.groupBy(*keys, "type").agg(
        F.min_by("__order", F.when(F.col("rotation") == 0, F.lit(0))).alias("keys"), F.collect_list("__p").alias("__all")
    )
    sums = F.aggregate(
        "__all", F.transform("keys", lambda _: F.lit(0.0)), lambda s, p: F.zip_with(s, p, lambda a, b: a + b),
        lambda s: F.transform(s, lambda x: x / F.size("__all")),
    )
    return met.select(*keys, "type", "keys", sums.alias("p"))


def usage(tokens: DataFrame, key: str = "id") -> DataFrame:
    """Input tokens per request: the state once plus its unrotated questions; output is zero."""
    return tokens.groupBy(key).agg(
        (
            F.max("state_tokens")
            + F.sum(F.when(F.col("rotation") == 0, F.col("question_tokens")).otherwise(0))
        ).alias("input_tokens"),
        F.lit(0).alias("output_tokens"),
    )


def shared_states(
    rows: DataFrame,
    state: str,
    encode: Callable[[DataFrame], DataFrame],
    *,
    row_key: Column,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Run ``encode`` once per distinct state and hand the result to every row that shares it.

    ``encode`` receives one row per state (``state_sha``, the state, ``n``) and adds columns. Equal
    states collapse map-side; a state held by very many rows is split on the way back.
    """
    keyed = rows.withColumn("state_sha", F.sha2(F.col(state), 256))
    distinct = keyed.groupBy("state_sha").agg(
        F.any_value(state).alias(state), F.count(F.lit(1)).alias("n")
    )
    encoded = encode(distinct).drop(state)
    options = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    # The hot list comes from the counts, so that ``encode`` is in the plan once.
    return fan_out_join(keyed, encoded, "state_sha", row_key, counts=distinct.select("state_sha", "n"), **options)
