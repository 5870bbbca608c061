"""Canonical records: JSON text to typed columns and back.

One row per record. Questions, targets and views are ordered arrays of structs, so every rule of the
format is a narrow projection: no shuffle, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import BOOLEAN, CHOICE, SCORE
from assayer.functions import json as J
from assayer.functions.tape import Shape, named_objects, scanned

STRINGS = "array<string>"
LEAVES = Shape({"*": None})
REQUEST = Shape({"images": LEAVES, "questions": Shape({"*": Shape({"criteria": LEAVES, "*": None})}), "*": None})
VIEWS = Shape({"*": Shape({"equivalence": LEAVES, "request": REQUEST, "*": None})})
TARGETS = Shape({"*": Shape({"values": LEAVES, "*": None})})


def record_shape(views: bool) -> Shape:
    """What is read of a record; the rest stays JSON text."""
    shape = {"request": REQUEST, "targets": TARGETS, "question_weights": LEAVES, "*": None}
    return Shape(shape | ({"views": VIEWS} if views else {}))


def _keys(members: Column) -> Column:
    return F.transform(members, lambda e: e["key"])


def _string_member(members: Column, name: str) -> Column:
    """The member's value when it is a string, else NULL."""
    found = F.filter(members, lambda e: (e["key"] == name) & (e["kind"] == "string"))
    return F.get(found, F.lit(0))["text"]


def _below(members: Column, name: str) -> Column:
    """The members of one member, none when it is absent or no container."""
    return F.flatten(F.transform(F.filter(members, lambda e: e["key"] == name), lambda e: e["members"]))


def _if_object(e: Column) -> Column:
    """The members of an object, none of anything else."""
    return F.filter(e["members"], lambda _: e["kind"] == "object")


def _kind_of(members: Column, name: str) -> Column:
    found = F.get(F.filter(members, lambda e: e["key"] == name), F.lit(0))
    return F.coalesce(found["kind"], F.lit("absent"))


def outcome_keys(kind: Column, criteria_keys: Column) -> Column:
    """Ordered outcome names of a question."""
    levels = F.when(
        F.size(criteria_keys) > 0,
        F.transform(F.sequence(F.lit(0), F.size(criteria_keys) - 1), lambda i: i.cast("string")),
    ).otherwise(F.array().cast(STRINGS))
    return (
        F.when(kind == CHOICE, criteria_keys)
        .when(kind == SCORE, levels)
        .when(kind == BOOLEAN, F.array(F.lit("true"), F.lit("false")))
    )


def question(
    qid: Column,
    kind: Column,
    criteria_keys: Column | None = None,
    descriptions: Column | None = None,
    instructions: Column | None = None,
    *,
    description_kinds: Column | None = None,
    criteria_kind: Column | None = None,
    instructions_kind: Column | None = None,
    is_object: Column | None = None,
    extra: Column | None = None,
) -> Column:
    """The question struct. Descriptions and instructions are JSON texts."""
    empty = F.array().cast(STRINGS)
    keys = criteria_keys if criteria_keys is not None else empty
    texts = descriptions if descriptions is not None else empty
    if criteria_kind is None:
        criteria_kind = (
            F.when(kind == SCORE, "array").when(kind == CHOICE, "object").otherwise("absent")
        )
    kinds = (
        description_kinds
        if description_kinds is not None
        else F.transform(texts, lambda t: F.lit("string"))
    )
    text = instructions if instructions is not None else F.lit(None).cast("string")
    if instructions_kind is None:
        instructions_kind = F.when(text.isNull(), "absent").otherwise("string")
    return F.struct(
        qid.alias("qid"),
        (is_object if is_object is not None else F.lit(True)).alias("is_object"),
        kind.alias("type"),
        text.alias("instructions_json"),
        instructions_kind.alias("instructions_kind"),
        criteria_kind.alias("criteria_kind"),
        keys.alias("criteria_keys"),
        texts.alias("descriptions"),
        kinds.alias("description_kinds"),
        (extra if extra is not None else empty).alias("fields"),
        outcome_keys(kind, keys).alias("keys"),
    )


def _parse_question(e: Column) -> Column:
    def with_members(m: Column) -> Column:
        def with_criteria(c: Column) -> Column:
            return J.let(_string_member(m, "type"), lambda kind: typed(kind, c))

        def typed(kind: Column, c: Column) -> Column:
            return question(
                e["key"], kind, F.transform(c, lambda x: x["key"]),
                F.transform(c, lambda x: x["json"]), J.member(m, "instructions"),
                description_kinds=F.transform(c, lambda x: x["kind"]), criteria_kind=_kind_of(m, "criteria"),
                instructions_kind=_kind_of(m, "instructions"), is_object=e["kind"] == "object",
                extra=_keys(m),
            )

        return J.let(_below(m, "criteria"), with_criteria)

    return J.let(_if_object(e), with_members)


def target(
    qid: Column,
    kind: Column,
    *,
    p_true: Column | None = None,
    value: Column | None = None,
    dist_keys: Column | None = None,
    dist: Column | None = None,
    allowed: Column | None = None,
    fields: Column | None = None,
    is_object: Column | None = None,
    p_true_kind: Column | None = None,
    value_kind: Column | None = None,
    values_kind: Column | None = None,
    value_kinds: Column | None = None,
) -> Column:
    """The target struct. ``dist`` follows ``dist_keys``; kinds are those of the JSON members."""
    nothing = F.lit(None)

    def known(given: Column | None, value: Column | None, name: str) -> Column:
        if given is not None:
            return given
        return F.lit("absent") if value is None else F.when(value.isNull(), "null").otherwise(name)

    many = dist if dist is not None else allowed
    if fields is None:
        names = ["kind"] + [
            n for n, v in (("p_true", p_true), ("value", value), ("values", many)) if v is not None
        ]
        fields = F.array(*[F.lit(n) for n in names])
    if value_kinds is None:
        if dist is not None:
            value_kinds = F.transform(dist, lambda x: F.when(x.isNull(), "null").otherwise("float"))
        elif allowed is not None:
            value_kinds = F.transform(allowed, lambda x: F.when(x.isNull(), "null").otherwise("string"))
        else:
            value_kinds = nothing.cast(STRINGS)
    list_kind = "object" if dist is not None else "array"
    as_type = lambda c, t: (nothing if c is None else c).cast(t)
    return F.struct(
        qid.alias("qid"),
        (is_object if is_object is not None else F.lit(True)).alias("is_object"),
        kind.alias("kind"),
        as_type(p_true, "double").alias("p_true"),
        as_type(value, "string").alias("value"),
        as_type(dist_keys, STRINGS).alias("dist_keys"),
        as_type(dist, "array<double>").alias("dist"),
        as_type(allowed, STRINGS).alias("allowed"),
        fields.alias("fields"),
        known(p_true_kind, p_true, "float").alias("p_true_kind"),
        known(value_kind, value, "string").alias("value_kind"),
        known(values_kind, many, list_kind).alias("values_kind"),
        value_kinds.alias("value_kinds"),
    )


def _number(text: Column, kind: Column) -> Column:
    return F.when(kind.isin("integer", "float"), text.try_cast("double"))


def _parse_target(e: Column) -> Column:
    def with_members(m: Column) -> Column:
        vkind = _kind_of(m, "values")

        def with_values(v: Column) -> Column:
            return target(
                e["key"], _string_member(m, "kind"),
                p_true=_number(J.member(m, "p_true"), _kind_of(m, "p_true")),
                value=_string_member(m, "value"),
                dist_keys=F.when(vkind == "object", F.transform(v, lambda x: x["key"])),
                dist=F.when(
                    vkind == "object", F.transform(v, lambda x: _number(x["json"], x["kind"]))
                ),
                allowed=F.when(
                    vkind == "array",
                    F.transform(
                        v, lambda x: F.when(x["kind"] == "string", x["text"])
                    ),
                ),
                fields=_keys(m), is_object=e["kind"] == "object",
                p_true_kind=_kind_of(m, "p_true"), value_kind=_kind_of(m, "value"),
                values_kind=vkind, value_kinds=F.transform(v, lambda x: x["kind"]),
            )

        return J.let(_below(m, "values"), with_values)

    return J.let(_if_object(e), with_members)


def _parse_request(members: Column, kind: Column) -> Column:
    """The request struct: fields, model kind, state, images and ordered questions."""

    def with_members(m: Column) -> Column:
        ikind = _kind_of(m, "images")
        qkind = _kind_of(m, "questions")
        pictures = F.when(
            ikind == "array",
            F.transform(_below(m, "images"), lambda x: F.when(x["kind"] == "string", x["text"])),
        )
        asked = F.filter(_below(m, "questions"), lambda _: qkind == "object")
        return F.struct(
            (kind == "object").alias("is_object"),
            _keys(m).alias("fields"),
            _kind_of(m, "model").alias("model_kind"),
            _string_member(m, "model").alias("model"),
            _kind_of(m, "state").alias("state_kind"),
            J.member(m, "state").alias("state_json"),
            ikind.alias("images_kind"),
            pictures.alias("images"),
            qkind.alias("questions_kind"),
            F.transform(asked, _parse_question).alias("questions"),
        )

    return J.let(F.filter(members, lambda _: kind == "object"), with_members)


def request(
    state: Column, questions: Column, images: Column | None = None, state_kind: Column | None = None
) -> Column:
    """A request struct from typed parts; ``state`` is JSON text."""
    return F.struct(
        F.lit(True).alias("is_object"),
        F.array(F.lit("state"), F.lit("questions")).alias("fields"),
        F.lit("absent").alias("model_kind"),
        F.lit(None).cast("string").alias("model"),
        (state_kind if state_kind is not None else F.when(state.isNull(), "null").otherwise("string"))
        .alias("state_kind"),
        state.alias("state_json"),
        (F.lit("absent") if images is None else F.lit("array")).alias("images_kind"),
        (F.lit(None).cast(STRINGS) if images is None else images).alias("images"),
        F.lit("object").alias("questions_kind"),
        questions.alias("questions"),
    )


def _parse_view(item: Column) -> Column:
    def with_members(m: Column) -> Column:
        def with_eq(q: Column) -> Column:
            return F.struct(
                (item["kind"] == "object").alias("is_object"),
                _keys(m).alias("fields"),
                _string_member(m, "view_id").alias("view_id"),
                (J.member(q, "verified") == "true").alias("verified"),
                _string_member(q, "relation").alias("relation"),
                F.when(_kind_of(q, "readout_scope") == "absent", "question_only")
                .otherwise(F.coalesce(_string_member(q, "readout_scope"), F.lit("")))
                .alias("scope"),
                _string_member(q, "method").alias("method"),
                _string_member(q, "reference").alias("reference"),
                _parse_request(_below(m, "request"), _kind_of(m, "request")).alias("request"),
            )

        return J.let(F.filter(_below(m, "equivalence"), lambda _: _kind_of(m, "equivalence") == "object"), with_eq)

    return J.let(_if_object(item), with_members)


def parse_records(df: DataFrame, text: str = "value", *, views: bool = True) -> DataFrame:
    """Typed columns of record JSON, from one walk over its bytes. Nothing is rejected here; see ``validate``."""
    tape = df.withColumns({"__tape": scanned(F.col(text), record_shape(views)), "record_json": F.col(text)})
    df = tape.withColumns(
        {
            "strict": F.col("__tape.strict"),
            "finite": F.col("__tape.strict") & F.col("__tape.finite"),
            "is_object": F.coalesce(F.col("__tape.kind") == "object", F.lit(False)),
        }
    ).withColumn("__m", F.filter("__tape.members", lambda _: F.col("is_object"))).drop("__tape")
    m = F.col("__m")
    columns = {
        "fields": _keys(m),
        "schema_version": _string_member(m, "schema_version"),
        "id": _string_member(m, "id"),
        "task_id": _string_member(m, "task_id"),
        "metadata_kind": _kind_of(m, "metadata"),
        "metadata_json": J.member(m, "metadata"),
        "weight_kind": _kind_of(m, "weight"),
        "weight": F.when(_kind_of(m, "weight") == "absent", 1.0).otherwise(
            _number(J.member(m, "weight"), _kind_of(m, "weight"))
        ),
        "request": _parse_request(_below(m, "request"), _kind_of(m, "request")),
        "targets_kind": _kind_of(m, "targets"),
        "targets": F.transform(F.filter(_below(m, "targets"), lambda _: _kind_of(m, "targets") == "object"), _parse_target),
        "question_weights_kind": _kind_of(m, "question_weights"),
        "question_weights": F.transform(
            F.filter(_below(m, "question_weights"), lambda _: _kind_of(m, "question_weights") == "object"),
            lambda e: F.struct(e["key"].alias("qid"), _number(e["json"], e["kind"]).alias("weight")),
        ),
    }
    if views:
        columns["views_kind"] = _kind_of(m, "views")
        columns["views"] = F.when(_kind_of(m, "views") == "array", F.transform(_below(m, "views"), _parse_view))
    return with_metadata(df.withColumns(columns).drop("__m"))


def with_metadata(df: DataFrame) -> DataFrame:
    """Add split group, its inferred flag and the dataset name from the metadata text."""
    meta = F.try_parse_json("metadata_json")
    name = F.try_variant_get(meta, "$.dataset", "string")
    return df.withColumns(
        {
            "split_group": F.try_variant_get(meta, "$.split_group", "string"),
            "split_group_inferred": F.coalesce(
                F.try_variant_get(meta, "$.split_group_inferred", "boolean"), F.lit(False)
            ),
            "dataset": F.coalesce(F.nullif(name, F.lit("")), F.split_part("id", F.lit(":"), F.lit(1))),
        }
    )


def question_json(q: Column) -> Column:
    """Compact JSON of a question struct."""
    criteria = (
        F.when(q["criteria_kind"] == "array", J.array_of(q["descriptions"]))
        .when(q["criteria_kind"] == "object", J.object_from(q["criteria_keys"], q["descriptions"]))
        .when(q["criteria_kind"] == "null", F.lit("null"))
    )
    return J.object_of(
        [("type", J.quote(q["type"])), ("instructions", q["instructions_json"]), ("criteria", criteria)]
    )


def request_json(r: Column, references: Column | None = None) -> Column:
    """Compact JSON of a request struct; ``references`` are JSON texts that stand for its images."""
    questions = J.object_from(
        F.transform(r["questions"], lambda q: q["qid"]), F.transform(r["questions"], question_json)
    )
    listed = F.transform(r["images"], J.quote) if references is None else references
    images = F.when(r["images"].isNotNull(), J.array_of(listed))
    return J.object_of(
        [
            ("model", F.when(r["model"].isNotNull(), J.quote(r["model"]))),
            ("state", r["state_json"]), ("questions", questions), ("images", images),
        ]
    )


def number_json(x: Column) -> Column:
    return F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)


def target_json(t: Column) -> Column:
    values = F.when(
        t["kind"] == "distribution",
        J.object_from(t["dist_keys"], F.transform(t["dist"], number_json)),
    ).when(t["kind"] == "allowed_set", J.array_of(F.transform(t["allowed"], J.quote)))
    return J.object_of(
        [
            ("kind", J.quote(t["kind"])),
            ("p_true", F.when(t["kind"] == "bernoulli", number_json(t["p_true"]))),
            ("value", F.when(t["kind"] == "class", J.quote(t["value"]))),
            ("values", values),
        ]
    )


def view_json(v: Column, references: Column | None = None) -> Column:
    eq = J.object_of(
        [
            ("verified", v["verified"].cast("string")), ("relation", J.quote(v["relation"])),
            ("method", J.quote(v["method"])), ("reference", J.quote(v["reference"])),
            ("readout_scope", J.quote(v["scope"])),
        ]
    )
    return J.object_of(
        [("view_id", J.quote(v["view_id"])), ("request", request_json(v["request"], references)), ("equivalence", eq)]
    )


def record_json(df: DataFrame, references: Column | None = None, view_references=None) -> Column:
    """Compact JSON of a typed record, in the field order of the format. ``references`` and
    ``view_references(view, index)`` replace the images of the base request and of each view."""
    targets = J.object_from(
        F.transform("targets", lambda t: t["qid"]), F.transform("targets", target_json)
    )
    pairs = [
        ("schema_version", J.quote(F.col("schema_version"))),
        ("id", J.quote(F.col("id"))),
        ("task_id", J.quote(F.col("task_id"))),
        ("request", request_json(F.col("request"), references)),
        ("targets", targets),
        ("metadata", F.col("metadata_json")),
    ]
    if "weight" in df.columns:
        pairs.append(("weight", F.when(F.col("weight") != 1.0, number_json(F.col("weight")))))
    if "question_weights" in df.columns:
        weights = J.object_from(
            F.transform("question_weights", lambda w: w["qid"]),
            F.transform("question_weights", lambda w: number_json(w["weight"])),
        )
        pairs.append(("question_weights", F.when(F.size("question_weights") > 0, weights)))
    if "views" in df.columns:
        every = F.transform(
            "views", lambda v, i: view_json(v, view_references(v, i) if view_references else None)
        )
        pairs.append(("views", F.when(F.col("views").isNotNull(), J.array_of(every))))
    return J.object_of(pairs)


def exploded_questions(df: DataFrame, *, supervised: bool = False) -> DataFrame:
    """One row per question with its target and its share of the record weight.

    The share is computed inside the row, before the explode, so no window or join is needed.
    """
    weight_of = lambda qid: F.coalesce(
        F.get(F.filter("question_weights", lambda w: w["qid"] == qid), F.lit(0))["weight"], F.lit(1.0)
    )
    df = df.withColumn(
        "__total",
        F.aggregate(F.transform("targets", lambda t: weight_of(t["qid"])), F.lit(0.0), lambda s, x: s + x),
    )
    def pair(q: Column) -> Column:
        t = F.get(F.filter("targets", lambda t: t["qid"] == q["qid"]), F.lit(0))
        return F.struct(
            q["qid"].alias("qid"), q["type"].alias("type"), q["keys"].alias("keys"),
            q["descriptions"].alias("descriptions"), q["instructions_json"].alias("instructions_json"),
            t.alias("target"), weight_of(q["qid"]).alias("question_weight"),
        )
    rows = df.select(
        *[c for c in ("id", "task_id", "dataset", "split_group") if c in df.columns],
        F.col("weight").alias("record_weight"), "__total",
        F.posexplode(F.transform("request.questions", pair)).alias("q_pos", "q"),
    ).select("*", "q.*").drop("q")
    out = rows.select(
        *[c for c in rows.columns if c not in ("target", "__total")],
        F.col("target.kind").alias("kind"), F.col("target.p_true").alias("p_true"),
        F.col("target.value").alias("value"),
        F.transform(
            "keys", lambda k: F.get(F.col("target.dist"), F.array_position("target.dist_keys", k).cast("int") - 1)
        ).alias("dist"),
        F.col("target.allowed").alias("allowed_keys"),
        (F.col("record_weight") * F.col("question_weight") / F.col("__total")).alias("weight"),
    )
    return out.filter(F.col("kind").isNotNull()) if supervised else out


def model_inputs(df: DataFrame, view_index: int | None = None) -> Column:
    """What a model may see: state and questions in order, no ids, targets or metadata."""
    r = F.col("request") if view_index is None else F.get(F.col("views"), F.lit(view_index))["request"]
    return J.object_of(
        [("state", r["state_json"]), ("questions", J.array_of(F.transform(r["questions"], question_json)))]
    )


def supervised_request(df: DataFrame, view_index: int | None = None) -> Column:
    """The request with only its supervised questions: in target order for the base request, in the
    view's own order for a view."""
    names = F.transform("targets", lambda t: t["qid"])
    if view_index is None:
        r = F.col("request")
        kept = F.transform(
            "targets",
            lambda t: F.get(F.filter(r["questions"], lambda q: q["qid"] == t["qid"]), F.lit(0)),
        )
    else:
        r = F.get(F.col("views"), F.lit(view_index))["request"]
        kept = F.filter(r["questions"], lambda q: F.array_contains(names, q["qid"]))
    return r.withField("questions", kept)


def requests_anywhere(text: Column) -> Column:
    """ARRAY<STRING>: every object under a "request" key of a record text, however deep, in the order of the text; one inside another belongs to that."""
    return named_objects(text, "request")


def all_requests(df: DataFrame) -> DataFrame:
    """Base and view requests of every record: (id, view_index, request); -1 is the base."""
    base = F.array(F.struct(F.lit(-1).alias("view_index"), F.col("request").alias("request")))
    others = F.transform(
        "views", lambda v, i: F.struct(i.alias("view_index"), v["request"].alias("request"))
    )
    every = F.concat(base, F.coalesce(others, F.filter(base, lambda x: F.lit(False))))
    return df.select("id", F.inline(every))
