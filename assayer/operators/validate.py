"""Rules of the record format as one array of violations per row.

Every rule is evaluated; a row is accepted when the array is empty. ``quarantine`` splits a table,
``require_valid`` raises on the first bad row instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import (
    ALLOWED_SET, BERNOULLI, BOOLEAN, CHOICE, CLASS, DISTRIBUTION, IMAGE_URL, MAX_BODY_BYTES,
    MAX_LEVELS, MAX_OPTIONS, MIN_LEVELS, QUESTION_FIELDS, RECORD_FIELDS, REQUEST_FIELDS,
    SCHEMA_VERSION, SCORE, SUM_TOLERANCE, TARGET_FIELDS, VIEW_FIELDS, VIEW_RELATION,
)
from assayer.functions import json as J
from assayer.functions.tape import Shape, scanned

VIOLATIONS = "array<struct<path:string,rule:string>>"
ENTRY = ("string", "object", "array", "null")


def no_violations() -> Column:
    return F.array().cast(VIOLATIONS)


def rules(path: Column, checks: list[tuple[str, Column]]) -> Column:
    """Violations whose condition is true. A NULL condition does not fire."""
    found = F.array(
        *[F.when(cond, F.struct(path.alias("path"), F.lit(rule).alias("rule"))) for rule, cond in checks]
    )
    return F.filter(found, lambda v: v.isNotNull()).cast(VIOLATIONS)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _extra(fields: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(fields, F.array(*[F.lit(a) for a in allowed]))) > 0


def question_violations(q: Column, prefix: Column) -> Column:
    path = F.concat(prefix, q["qid"])
    kinds, n = q["description_kinds"], F.size(q["criteria_keys"])
    free = F.exists(kinds, lambda k: ~k.isin(*ENTRY))
    kind = q["type"]
    wrong_keys = F.exists(q["criteria_keys"], lambda k: ~k.isin("true", "false"))
    given = ~q["criteria_kind"].isin("absent", "null")
    return rules(
        path,
        [
            ("object", ~q["is_object"]),
            ("unknown_fields", _extra(q["fields"], QUESTION_FIELDS)),
            ("instructions", ~q["instructions_kind"].isin("absent", *ENTRY)),
            ("choice_options", (kind == CHOICE)
             & ((q["criteria_kind"] != "object") | ~n.between(1, MAX_OPTIONS))),
            ("choice_option", (kind == CHOICE)
             & (F.exists(q["criteria_keys"], lambda k: k == "") | free)),
            ("score_levels", (kind == SCORE)
             & ((q["criteria_kind"] != "array") | ~n.between(MIN_LEVELS, MAX_LEVELS))),
            ("score_description", (kind == SCORE) & (q["criteria_kind"] == "array")
             & F.exists(kinds, lambda k: ~k.isin("string", "object", "array"))),
            ("noul_keys", (kind == BOOLEAN) & given & ((q["criteria_kind"] != "object") | wrong_keys)),
            ("noul_description", (kind == BOOLEAN) & given & free),
            ("unknown_type", F.coalesce(~kind.isin(CHOICE, SCORE, BOOLEAN), F.lit(True))),
        ],
    )


def request_violations(r: Column, where: str) -> Column:
    path = F.lit(where)
    images = F.exists(r["images"], lambda i: ~F.coalesce(i.rlike(IMAGE_URL), F.lit(False)))
    own = rules(
        path,
        [
            ("object", ~r["is_object"]),
            ("unknown_fields", _extra(r["fields"], REQUEST_FIELDS)),
            ("state", ~r["state_kind"].isin("string", "object", "array")),
            ("model", ~r["model_kind"].isin("absent", "string")),
            ("images", ~r["images_kind"].isin("absent", "array") | F.coalesce(images, F.lit(False))),
            ("questions", (r["questions_kind"] != "object") | (F.size(r["questions"]) == 0)),
            ("question_id", F.exists(r["questions"], lambda q: q["qid"] == "")),
        ],
    )
    prefix = F.lit(f"{where}.questions.")
    return F.concat(
        own, F.flatten(F.transform(r["questions"], lambda q: question_violations(q, prefix)))
    )


def target_violations(t: Column, q: Column, prefix: Column | None = None) -> Column:
    """Rules of one target against its question struct."""
    path = F.concat(prefix if prefix is not None else F.lit("targets."), t["qid"])
    keys, kind = q["keys"], t["kind"]
    boolean = q["type"] == BOOLEAN
    other = ~boolean
    total = F.aggregate(t["dist"], F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    bad_p = F.coalesce(~t["p_true"].between(0, 1) | F.isnan(t["p_true"]), F.lit(True))
    numeric = ("integer", "float")
    return rules(
        path,
        [
            ("object", ~t["is_object"]),
            ("noul_target", boolean & (F.coalesce(kind != BERNOULLI, F.lit(True))
                                       | (t["p_true_kind"] == "absent")
                                       | _extra(t["fields"], TARGET_FIELDS[BERNOULLI]))),
            ("probability", boolean & (t["p_true_kind"] != "absent")
             & (~t["p_true_kind"].isin(*numeric) | bad_p)),
            ("target_kind", other & F.coalesce(~kind.isin(CLASS, DISTRIBUTION, ALLOWED_SET), F.lit(True))),
            ("unknown_fields", other & (((kind == CLASS) & _extra(t["fields"], TARGET_FIELDS[CLASS]))
                                        | (kind.isin(DISTRIBUTION, ALLOWED_SET)
                                           & _extra(t["fields"], TARGET_FIELDS[DISTRIBUTION])))),
            ("class_value", other & (kind == CLASS)
             & ((t["value_kind"] != "string") | ~F.coalesce(F.array_contains(keys, t["value"]), F.lit(False)))),
            ("distribution_keys", other & (kind == DISTRIBUTION)
             & ((t["values_kind"] != "object") | (F.size(F.array_except(keys, t["dist_keys"])) > 0)
                | (F.size(F.array_except(t["dist_keys"], keys)) > 0))),
            ("probability", other & (kind == DISTRIBUTION)
             & (F.exists(t["value_kinds"], lambda k: ~k.isin(*numeric))
                | F.exists(t["dist"], lambda p: F.coalesce(~p.between(0, 1), F.lit(True))))),
            ("distribution_sum", other & (kind == DISTRIBUTION) & (t["values_kind"] == "object")
             & (F.abs(total - 1) > SUM_TOLERANCE)),
            ("allowed_set", other & (kind == ALLOWED_SET)
             & ((t["values_kind"] != "array") | (F.size(t["allowed"]) == 0)
                | F.exists(t["value_kinds"], lambda k: k != "string"))),
            ("allowed_outcome", other & (kind == ALLOWED_SET) & (t["values_kind"] == "array")
             & ((F.size(F.array_distinct(t["allowed"])) != F.size(t["allowed"]))
                | (F.size(F.array_except(t["allowed"], keys)) > 0))),
        ],
    )


def _find(questions: Column, qid: Column) -> Column:
    return F.get(F.filter(questions, lambda q: q["qid"] == qid), F.lit(0))


def _qids(items: Column) -> Column:
    return F.transform(items, lambda x: x["qid"])


def record_violations(df: DataFrame) -> Column:
    """All rules of one record, views excluded."""
    parsed = "strict" in df.columns
    questions, targets = F.col("request")["questions"], F.col("targets")
    checks = []
    if parsed:
        checks += [
            ("finite_json", ~F.col("finite")),
            ("unknown_fields", _extra(F.col("fields"), RECORD_FIELDS)),
            ("metadata", ~F.col("metadata_kind").isin("absent", "object")),
            ("weight", F.col("weight").isNull()),
            ("question_weights", ~F.col("question_weights_kind").isin("absent", "object")),
            ("targets", F.col("targets_kind") != "object"),
        ]
    checks += [
        ("schema_version", F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True))),
        ("id", _blank(F.col("id"))),
        ("task_id", _blank(F.col("task_id"))),
        ("weight", F.col("weight") <= 0),
        ("targets", (F.size(targets) == 0)
         | (F.size(F.array_except(_qids(targets), _qids(questions))) > 0)),
        ("question_weights", F.size(F.array_except(_qids(F.col("question_weights")), _qids(targets))) > 0),
        ("question_weight", F.exists("question_weights", lambda w: F.coalesce(w["weight"] <= 0, F.lit(True)))),
    ]
    per_target = F.transform(
        F.filter(targets, lambda t: F.array_contains(_qids(questions), t["qid"])),
        lambda t: J.let(_find(questions, t["qid"]), lambda q: target_violations(t, q)),
    )
    every = F.concat(
        rules(F.lit("record"), checks),
        request_violations(F.col("request"), "request"),
        F.flatten(per_target),
    )
    if not parsed:
        return every
    only = lambda rule: rules(F.lit("record"), [(rule, F.lit(True))])
    return (
        F.when(~F.col("strict"), only("strict_json"))
        .when(~F.col("is_object"), only("object"))
        .otherwise(every)
    )


def view_violations(v: Column) -> Column:
    """Rules of one view against its record (columns ``request`` and ``targets``)."""
    base, targets = F.col("request")["questions"], F.col("targets")
    other = v["request"]["questions"]
    changed = F.exists(
        other,
        lambda q: F.coalesce(
            (_find(base, q["qid"])["type"] != q["type"]) | (_find(base, q["qid"])["keys"] != q["keys"]),
            F.lit(False),
        ),
    )
    own = rules(
        F.concat(F.lit("views."), F.coalesce(v["view_id"], F.lit("?"))),
        [
            ("object", ~v["is_object"]),
            ("unknown_fields", _extra(v["fields"], VIEW_FIELDS)),
            ("view_id", _blank(v["view_id"])),
            ("verified", ~F.coalesce(v["verified"], F.lit(False))),
            ("relation", F.coalesce(v["relation"] != VIEW_RELATION, F.lit(True))),
            ("readout_scope", ~v["scope"].isin("question_only", "all_readouts")),
            ("method", _blank(v["method"])),
            ("reference", _blank(v["reference"])),
            ("question_subset", F.size(F.array_except(_qids(other), _qids(base))) > 0),
            ("ordered_outcomes", changed),
            ("no_supervised_question", ~F.coalesce(F.arrays_overlap(_qids(other), _qids(targets)), F.lit(False))),
        ],
    )
    per_target = F.transform(
        F.filter(targets, lambda t: F.array_contains(_qids(other), t["qid"])),
        lambda t: J.let(
            _find(other, t["qid"]), lambda q: target_violations(t, q, F.lit("view.targets."))
        ),
    )
    return F.concat(own, request_violations(v["request"], "view.request"), F.flatten(per_target))


def audit_views(df: DataFrame) -> DataFrame:
    """Add ``accepted_views`` and ``rejected_views`` (index, reasons). A bad view never rejects its
    record; every copy of a repeated view id is rejected. Views that are no list are one rejection without an index."""
    counts = lambda v: F.size(F.filter("views", lambda w: w["view_id"] == v["view_id"]))
    audited = F.transform(
        "views",
        lambda v, i: F.struct(
            i.alias("index"), v.alias("view"),
            F.concat(
                view_violations(v),
                rules(F.lit("views"), [("duplicate_view_id", (v["view_id"] != "") & (counts(v) > 1))]),
            ).alias("violations"),
        ),
    )
    df = df.withColumn("__audit", audited)
    good = F.filter("__audit", lambda a: F.size(a["violations"]) == 0)
    bad = F.filter("__audit", lambda a: F.size(a["violations"]) > 0)
    rejected = F.transform(
        bad,
        lambda a: F.struct(a["index"].alias("index"), F.transform(a["violations"], lambda x: x["rule"]).alias("reasons")),
    )
    if "views_kind" in df.columns:
        whole = F.array(F.struct(F.lit(None).cast("int").alias("index"), F.array(F.lit("views_list")).alias("reasons")))
        rejected = F.when(~F.col("views_kind").isin("absent", "array"), whole).otherwise(rejected)
    return df.withColumns(
        {
            "accepted_views": F.coalesce(F.transform(good, lambda a: a["view"]),
                                         F.filter("views", lambda v: F.lit(False))),
            "rejected_views": rejected,
        }
    ).drop("__audit")


def evaluated_once(column: Column) -> Column:
    """Keep the optimizer from copying an expensive column into the filters that read it: a filter
    is only pushed below a projection that is deterministic. The value itself does not change."""
    return F.when(F.rand(0) + 1 > 0, column)


def validated(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", evaluated_once(record_violations(df)))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, one row per violation). The rules are evaluated per row in each branch."""
    checked = validated(df)
    place = [c for c in ("source_file", "line", "id") if c in df.columns]
    bad = checked.filter(F.size("violations") > 0).select(*place, F.inline("violations"))
    return checked.filter(F.size("violations") == 0).drop("violations"), bad


def violation_counts(df: DataFrame) -> DataFrame:
    """Records per broken rule, and the accepted ones as rule "accepted". One pass, combined
    map-side: a record counts once per rule."""
    names = F.array_distinct(F.transform("violations", lambda v: v["rule"]))
    listed = F.when(F.size(names) == 0, F.array(F.lit("accepted"))).otherwise(names)
    return (
        validated(df).select(F.explode(listed).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    )


def require_valid(df: DataFrame) -> DataFrame:
    """The same rows; the first invalid one fails the job."""
    checked = validated(df)
    message = F.concat(F.lit("invalid record "), F.coalesce("id", F.lit("?")), F.lit(": "), F.to_json("violations"))
    guarded = F.when(F.size("violations") == 0, F.col("id")).otherwise(F.raise_error(message).cast("string"))
    return checked.withColumn("id", guarded).drop("violations")


def validation_report(df: DataFrame) -> DataFrame:
    """One row: records, eligible views, rejected views, records with a rejected view."""
    audited = audit_views(df)
    return audited.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.coalesce(F.size("accepted_views"), F.lit(0))).alias("eligible_views"),
        F.sum(F.coalesce(F.size("rejected_views"), F.lit(0))).alias("rejected_views"),
        F.count_if(F.size("rejected_views") > 0).alias("records_with_rejections"),
    )


def admission(
    df: DataFrame, text: str = "value", model: str | None = None, *, tokens: Column | None = None, budget: int | None = None
) -> DataFrame:
    """Add ``admission``: NULL for a usable request body, else why it is refused. A body whose ``tokens`` are over ``budget`` is refused as "budget", never cut."""
    body = F.col(text)
    size = F.octet_length(body)
    tape = F.col("__tape")
    named = F.get(tape["members"], F.lit(0))
    reason = (
        F.when(body.isNull() | ~size.between(1, MAX_BODY_BYTES), "size")
        .when(~tape["strict"], "strict_json")
        .when(tape["kind"] != "object", "object")
        .when(~tape["finite"], "finite_json")
    )
    if model is not None:
        reason = reason.when(F.when(named["kind"] == "string", named["text"]).otherwise(model) != model, "model")
    if budget is not None:
        reason = reason.when(tokens > budget, "budget")
    return df.withColumn("__tape", scanned(body, Shape({"model": None}))).withColumn("admission", reason).drop("__tape")
