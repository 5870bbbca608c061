"""Labelled source tables to canonical records.

``normalize(df, config, task_id)`` compiles a configuration into column expressions over the whole
table. Configuration mistakes and missing columns fail when the plan is built; bad rows carry
``violations`` and are split off by ``accepted`` / ``rejected``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.constants import (
    ALLOWED_SET, BERNOULLI, BOOLEAN, CHOICE, CLASS, DISTRIBUTION, SCHEMA_VERSION, SCORE,
)
from assayer.functions import json as J
from assayer.operators import records as R
from assayer.operators.validate import evaluated_once, record_violations, rules

STRINGS = "array<string>"
TEXT_ADAPTERS = ("classification", "binary", "ordinal")
QUESTION_ADAPTERS = (*TEXT_ADAPTERS, "pair", "instruction", "chat_label")
KEEP_NULLS = {"ignoreNullFields": "false"}


class ConfigError(ValueError):
    """The configuration does not fit the source table."""


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


class Source:
    """A source table with its role -> column mapping."""

    def __init__(self, df: DataFrame, fields: dict[str, str]):
        self.df, self.fields = df, fields

    def name(self, role: str) -> str:
        name = self.fields.get(role, role)
        if name not in self.df.columns:
            raise ConfigError(f"missing source column {name!r} (role: {role})")
        return name

    def has(self, name: str) -> bool:
        return name in self.df.columns

    def column(self, role: str) -> Column:
        return F.col(f"`{self.name(role)}`")

    def type(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType


def json_of(column: Column, dtype: T.DataType) -> Column:
    """JSON text of a column of any type."""
    if isinstance(dtype, T.StringType):
        text = J.quote(column)
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(column, KEEP_NULLS)
    elif isinstance(dtype, T.VariantType):
        text = F.to_json(column)
    else:
        text = R.number_json(column)
    return F.when(column.isNull(), "null").otherwise(text)


def json_kind(dtype: T.DataType, column: Column) -> Column:
    if isinstance(dtype, T.VariantType):
        return J.kind(column)
    name = (
        "string" if isinstance(dtype, T.StringType)
        else "object" if isinstance(dtype, (T.StructType, T.MapType))
        else "array" if isinstance(dtype, T.ArrayType)
        else "boolean" if isinstance(dtype, T.BooleanType)
        else "float"
    )
    return F.when(column.isNull(), "null").otherwise(name)


def source_label(column: Column, dtype: T.DataType, label_type: str) -> Column:
    """The label with its declared type, or NULL when the value does not have it."""
    if label_type == "string":
        return column if isinstance(dtype, T.StringType) else F.lit(None).cast("string")
    if label_type == "integer":
        if isinstance(dtype, T.StringType):
            return F.when(column.rlike(r"^-?[0-9]+$"), column.try_cast("bigint"))
        if isinstance(dtype, T.IntegralType):
            return column.cast("bigint")
        return F.lit(None).cast("bigint")
    if label_type == "boolean":
        if isinstance(dtype, T.StringType):
            return F.when(column.isin("true", "false"), column == "true")
        return column if isinstance(dtype, T.BooleanType) else F.lit(None).cast("boolean")
    raise ConfigError(f"unknown label_type {label_type}")


PYTHON_TYPES = {"string": str, "integer": int, "boolean": bool}


def lookup(label: Column, label_map: list[dict], label_type: str, result: str) -> Column | None:
    """Type-exact lookup: only entries whose source has the declared type can match; the first
    entry of a repeated source wins. The map comes from a configuration, so it is a literal."""
    wanted = PYTHON_TYPES[label_type]
    pairs: dict = {}
    for entry in label_map:
        if type(entry["source"]) is wanted:
            pairs.setdefault(entry["source"], entry["target"])
    if not pairs:
        return None
    flat = [F.lit(x) for item in pairs.items() for x in item]
    return F.try_element_at(F.create_map(*flat), label).cast(result)


def map_label(
    column: Column, dtype: T.DataType, config: dict, keys: Column
) -> tuple[Column, list[tuple[str, Column]]]:
    """(outcome key, checks). The key is NULL when the row is in error."""
    label_type = config.get("label_type", "string")
    label = source_label(column, dtype, label_type)
    mapped = lookup(label, config.get("label_map", []), label_type, "string")
    own = F.when(F.array_contains(keys, label), label) if label_type == "string" else None
    options = [c for c in (mapped, own) if c is not None]
    key = F.coalesce(*options) if options else F.lit(None).cast("string")
    outside = (
        F.coalesce(~F.array_contains(keys, mapped), F.lit(False)) if mapped is not None else F.lit(False)
    )
    return key, [
        ("label_type", label.isNull()),
        ("label_map_outside", outside),
        ("unmapped_label", label.isNotNull() & key.isNull()),
    ]


def literal_question(q: dict, qid: str = "q", instructions: Column | None = None) -> Column:
    """A question struct from a configuration object."""
    criteria, kind = q.get("criteria"), q.get("type")
    if isinstance(criteria, dict):
        keys, values, ckind = list(criteria), list(criteria.values()), "object"
    elif isinstance(criteria, list):
        keys, values, ckind = [str(i) for i in range(len(criteria))], criteria, "array"
    else:
        keys, values, ckind = [], [], "absent" if "criteria" not in q else "null"
    names = {str: "string", dict: "object", list: "array", type(None): "null"}
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(STRINGS)
    text = instructions
    if text is None and "instructions" in q:
        text = F.lit(compact(q["instructions"]))
    kind_name = names.get(type(q.get("instructions")), "other")
    return R.question(
        F.lit(qid), F.lit(kind), strings(keys), strings([compact(v) for v in values]), text,
        description_kinds=strings([names.get(type(v), "other") for v in values]),
        criteria_kind=F.lit(ckind),
        instructions_kind=None if text is None or instructions is not None else F.lit(kind_name),
        extra=strings(list(q)),
    )


def make_target(
    src: Source, config: dict, keys: Column, boolean: bool, label: tuple[Column, T.DataType] | None = None
) -> tuple[Column, list[tuple[str, Column]]]:
    """(target struct for question "q", checks)."""
    kind, qid = config.get("target_kind", CLASS), F.lit("q")

    def label_column() -> tuple[Column, T.DataType]:
        return label or (src.column("label"), src.type(src.name("label")))

    if kind == BERNOULLI:
        p = src.column("p_true")
        dtype = src.type(src.name("p_true"))
        value = p.try_cast("double") if isinstance(dtype, T.StringType) else p.cast("double")
        bad = F.lit(isinstance(dtype, T.BooleanType)) | F.coalesce(
            ~value.between(0, 1) | F.isnan(value), F.lit(True)
        )
        return R.target(qid, F.lit(BERNOULLI), p_true=value), [("probability", bad)]
    if boolean:
        column, dtype = label_column()
        label_type = config.get("label_type", "string")
        value = source_label(column, dtype, label_type)
        mapped = lookup(value, config.get("label_map", []), label_type, "double")
        own = value.cast("double") if label_type == "boolean" else None
        options = [c for c in (mapped, own) if c is not None]
        p = F.coalesce(*options) if options else F.lit(None).cast("double")
        return R.target(qid, F.lit(BERNOULLI), p_true=p), [
            ("label_type", value.isNull()),
            ("binary_label_map", value.isNotNull() & p.isNull()),
            ("probability", F.coalesce(~p.between(0, 1), F.lit(False))),
        ]
    if kind == CLASS:
        column, dtype = label_column()
        key, checks = map_label(column, dtype, config, keys)
        return R.target(qid, F.lit(CLASS), value=key), checks
    if kind == ALLOWED_SET:
        name = src.name("allowed")
        dtype = src.type(name)
        if not isinstance(dtype, T.ArrayType):
            raise ConfigError("an allowed_set source must be a list column")
        mapped = F.transform(
            src.column("allowed"), lambda x: map_label(x, dtype.elementType, config, keys)[0]
        )
        return R.target(qid, F.lit(ALLOWED_SET), allowed=mapped), [
            ("unmapped_label", F.exists(mapped, lambda x: x.isNull()))
        ]
    if kind == DISTRIBUTION:
        name = src.name("probabilities")
        dtype, values = src.type(name), src.column("probabilities")
        if isinstance(dtype, T.ArrayType):
            order = config.get("probability_order")
            if not isinstance(order, list) or len(order) != len(set(order)):
                raise ConfigError("probability lists require an explicit probability_order")
            names = F.array(*[F.lit(o) for o in order])
            same = (
                (F.size(values) == len(order))
                & (F.size(keys) == len(order))
                & (F.size(F.array_except(keys, names)) == 0)
            )
            given = F.transform(
                keys, lambda k: F.get(values, F.array_position(names, k).cast("int") - 1).cast("double")
            )
            return R.target(qid, F.lit(DISTRIBUTION), dist_keys=keys, dist=given), [
                ("probability_order", ~F.coalesce(same, F.lit(False)))
            ]
        pairs = F.map_entries(values)
        return R.target(
            qid, F.lit(DISTRIBUTION), dist_keys=F.transform(pairs, lambda e: e["key"]),
            dist=F.transform(pairs, lambda e: e["value"].cast("double")),
        ), []
    raise ConfigError(f"unknown target_kind {kind!r}")


def _state(src: Source, role: str) -> tuple[Column, Column]:
    name = src.name(role)
    return json_of(src.column(role), src.type(name)), json_kind(src.type(name), src.column(role))


def _question_record(src: Source, config: dict):
    adapter, q = config["adapter"], config["question"]
    label = None
    checks: list[tuple[str, Column]] = []
    instructions = None
    if adapter == "pair":
        state = J.object_of(
            [
                (name, json_of(F.col(f"`{src.name(source)}`"), src.type(src.name(source))))
                for name, source in config["state_fields"].items()
            ]
        )
        kind = F.lit("object")
    elif adapter == "instruction":
        state, kind = _state(src, "input")
        instructions, _ = _state(src, "instruction")
    elif adapter == "chat_label":
        messages = src.column("messages")
        roles = F.transform(messages, lambda m: m["role"])
        short, long = [F.array(*[F.lit(r) for r in rs]) for rs in (
            ("user", "assistant"), ("system", "user", "assistant"))]
        known = F.coalesce((roles == short) | (roles == long), F.lit(False))
        checks = [
            ("chat_roles", ~known),
            ("chat_content", known & F.exists(messages, lambda m: m["content"].isNull())),
        ]
        text = lambda i: F.when(known, F.element_at(messages, F.lit(i))["content"])
        state, kind = J.quote(text(-2)), F.lit("string")
        own = F.lit(compact(q["instructions"])) if "instructions" in q else F.lit(None).cast("string")
        instructions = F.when(
            F.size(messages) == 3, J.quote(F.get(messages, F.lit(0))["content"])
        ).otherwise(own)
        label = (text(-1), T.StringType())
    else:
        state, kind = _state(src, "text")
    literal = literal_question(q, instructions=instructions)
    keys = F.array(*[F.lit(k) for k in _outcomes(q)])
    target, more = make_target(src, config, keys, q.get("type") == BOOLEAN, label)
    return state, kind, F.array(literal), F.array(target), [*checks, *more]


def _outcomes(q: dict) -> list[str]:
    if q.get("type") == CHOICE:
        return list(q["criteria"])
    if q.get("type") == SCORE:
        return [str(i) for i in range(len(q["criteria"]))]
    if q.get("type") == BOOLEAN:
        return ["true", "false"]
    raise ConfigError(f"unknown question type {q.get('type')!r}")


def _dynamic_choice(src: Source, config: dict):
    name = src.name("choices")
    dtype, column = src.type(name), src.column("choices")
    local = dict(config)
    if isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, T.StructType):
        if config.get("answer_encoding") != "index":
            raise ConfigError("a list of choices needs answers given by position")
        keys = F.transform(column, lambda _x, i: i.cast("string"))
        texts = F.transform(column, lambda x: json_of(x, dtype.elementType))
        index = source_label(src.column("label"), src.type(src.name("label")), "integer")
        key = F.when(F.array_contains(keys, index.cast("string")), index.cast("string"))
        checks = [("label_type", index.isNull()), ("unmapped_label", index.isNotNull() & key.isNull())]
        target = R.target(F.lit("q"), F.lit(CLASS), value=key)
        if config.get("target_kind", CLASS) != CLASS:
            target, checks = make_target(src, {**local, "label_map": []}, keys, False)
    else:
        if isinstance(dtype, T.MapType):
            pairs, value_type = F.map_entries(column), dtype.valueType
        elif isinstance(dtype, T.ArrayType):
            pairs = F.transform(column, lambda e: F.struct(e["key"].alias("key"), e["description"].alias("value")))
            value_type = dtype.elementType["description"].dataType
        else:
            raise ConfigError("choices must be a map, a list or a list of (key, description)")
        keys = F.transform(pairs, lambda e: e["key"])
        texts = F.transform(pairs, lambda e: json_of(e["value"], value_type))
        target, checks = make_target(src, local, keys, False)
    instructions, _ = _state(src, "instructions")
    state, kind = _state(src, "state")
    question = R.question(F.lit("q"), F.lit(CHOICE), keys, texts, instructions)
    return state, kind, F.array(question), F.array(target), checks


def _multilabel(src: Source, config: dict):
    criteria: dict = config["label_criteria"]
    names = F.array(*[F.lit(k) for k in criteria])
    state, kind = _state(src, "text")
    questions = F.array(
        *[
            literal_question(
                {"type": BOOLEAN,
                 "instructions": {"task": config["instructions"], "label": k, "definition": d}},
                qid=k,
            )
            for k, d in criteria.items()
        ]
    )
    if config["adapter"] == "multilabel_complete":
        labels = src.column("labels")
        checks = [
            ("labels", labels.isNull() | F.exists(labels, lambda x: x.isNull())),
            ("unknown_or_repeated_label", (F.size(F.array_distinct(labels)) != F.size(labels))
             | (F.size(F.array_except(labels, names)) > 0)),
        ]
        targets = F.transform(
            names, lambda k: R.target(k, F.lit(BERNOULLI), p_true=F.array_contains(labels, k).cast("double"))
        )
        return state, kind, questions, targets, checks
    states = F.map_entries(src.column("label_states"))
    checks = [
        ("label_states", src.column("label_states").isNull()),
        ("unknown_or_repeated_label",
         F.size(F.array_except(F.transform(states, lambda e: e["key"]), names)) > 0),
    ]
    # An unknown label has no target: it is left out, never 0 or 0.5.
    known = F.filter(states, lambda e: e["value"].isNotNull())
    targets = F.transform(
        known, lambda e: R.target(e["key"], F.lit(BERNOULLI), p_true=e["value"].cast("double"))
    )
    return state, kind, questions, targets, checks


def _metadata(src: Source, config: dict, task_id: str, state: Column) -> Column:
    fields = config.get("fields", {})
    given = J.entries(json_of(F.col("metadata"), src.type("metadata"))) if src.has("metadata") else None
    if given is not None and isinstance(src.type("metadata"), T.StringType):
        given = J.entries(F.col("metadata"))
    absent = (
        (lambda n: ~F.coalesce(F.exists(given, lambda e: e["key"] == n), F.lit(False)))
        if given is not None
        else (lambda n: F.lit(True))
    )
    column = fields.get("split_group", "split_group")
    if src.has(column):
        group, inferred = json_of(F.col(f"`{column}`"), src.type(column)), F.lit(False)
    else:
        group = J.quote(F.concat(F.lit(f"{task_id}:"), J.digest(state)))
        inferred = absent("split_group")
    added = J.object_of(
        [
            ("source", F.when(absent("source"), F.lit(compact(task_id)))),
            ("split_group", F.when(absent("split_group"), group)),
            ("split_group_inferred", F.when(inferred, F.lit("true"))),
        ]
    )
    if given is None:
        return added
    own = J.object_from(F.transform(given, lambda e: e["key"]), F.transform(given, lambda e: e["json"]))
    return F.concat(
        F.substring(own, F.lit(1), F.length(own) - 1),
        F.when((F.length(own) > 2) & (F.length(added) > 2), ",").otherwise(""),
        F.substring(added, F.lit(2), F.length(added)),
    )


def row_digest(df: DataFrame) -> Column:
    """Digest of all columns of a source row."""
    return J.digest(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), KEEP_NULLS))


def _alternative_view(src: Source, config: dict, request: Column) -> Column:
    column = config["view_state_field"]
    state = json_of(F.col(f"`{column}`"), src.type(column))
    part = lambda n, t="string": (
        F.col("view_verification")[n].cast(t)
        if src.has("view_verification") and n in src.type("view_verification").fieldNames()
        else F.lit(None).cast(t)
    )
    alternative = request.withField("state_json", state).withField(
        "state_kind", json_kind(src.type(column), F.col(f"`{column}`"))
    )
    return F.struct(
        F.lit(True).alias("is_object"),
        F.array(*[F.lit(n) for n in ("view_id", "request", "equivalence")]).alias("fields"),
        F.lit("alternative").alias("view_id"),
        part("verified", "boolean").alias("verified"),
        part("relation").alias("relation"),
        F.coalesce(part("readout_scope"), F.lit("question_only")).alias("scope"),
        part("method").alias("method"),
        part("reference").alias("reference"),
        alternative.alias("request"),
    )


def normalize(
    df: DataFrame,
    config: dict,
    task_id: str,
    *,
    hook: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Canonical records with a ``violations`` column. ``hook`` runs on the typed records, before
    the rules are checked (the place for a reviewed reordering of options)."""
    adapter = config["adapter"]
    if adapter == "native":
        out = _native(df, task_id)
        out = hook(out) if hook else out
        return out.withColumn("violations", evaluated_once(record_violations(out)))
    src = Source(df, config.get("fields", {}))
    if adapter in QUESTION_ADAPTERS:
        state, kind, questions, targets, checks = _question_record(src, config)
    elif adapter == "dynamic_choice":
        state, kind, questions, targets, checks = _dynamic_choice(src, config)
    elif adapter in ("multilabel_complete", "multilabel_partial"):
        state, kind, questions, targets, checks = _multilabel(src, config)
    else:
        raise ConfigError(f"unsupported adapter {adapter!r}")
    request = R.request(F.col("__state"), questions, state_kind=kind)
    extra: dict[str, Column] = {
        "weight": F.col("weight").cast("double") if src.has("weight") else F.lit(1.0),
        "question_weights": (
            F.transform(
                F.map_entries("question_weights"),
                lambda e: F.struct(e["key"].alias("qid"), e["value"].cast("double").alias("weight")),
            )
            if src.has("question_weights")
            else F.array().cast("array<struct<qid:string,weight:double>>")
        ),
    }
    if "view_state_field" in config and src.has(config["view_state_field"]):
        if src.has("views"):
            raise ConfigError("views come from a field or from another state, not from both")
        extra["views"] = F.array(_alternative_view(src, config, F.col("__request")))
    elif src.has("views"):
        extra["views"] = F.col("views")
    identity = (
        F.col("id").cast("string")
        if src.has("id")
        else F.concat(F.lit(f"{task_id}:"), row_digest(df))
    )
    staged = df.withColumn("__state", state)
    staged = staged.withColumns({"__request": request, "__targets": targets})
    out = staged.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        identity.alias("id"),
        F.lit(task_id).alias("task_id"),
        F.col("__request").alias("request"),
        F.col("__targets").alias("targets"),
        _metadata(src, config, task_id, F.col("__state")).alias("metadata_json"),
        *[c.alias(n) for n, c in extra.items()],
        rules(F.lit("adapter"), checks).alias("__problems"),
    )
    out = R.with_metadata(out)
    out = hook(out) if hook else out
    return out.withColumn(
        "violations",
        evaluated_once(
            F.when(F.size("__problems") > 0, F.col("__problems")).otherwise(record_violations(out))
        ),
    ).drop("__problems")


def _native(df: DataFrame, task_id: str) -> DataFrame:
    """Rows that already hold a record: one JSON text column ``value``, or ``request`` and
    ``targets`` as JSON text."""
    if "value" in df.columns:
        return R.parse_records(df, "value")
    src = Source(df, {})
    state = J.member(J.entries(src.column("request")), "state")
    identity = F.col("id").cast("string") if src.has("id") else F.concat(F.lit(f"{task_id}:"), row_digest(df))
    text = J.object_of(
        [
            ("schema_version", F.lit(compact(SCHEMA_VERSION))),
            ("id", J.quote(identity)),
            ("task_id", F.lit(compact(task_id))),
            ("request", src.column("request")),
            ("targets", src.column("targets")),
            ("metadata", _metadata(src, {}, task_id, state)),
            *[(n, json_of(F.col(n), src.type(n))) for n in ("weight", "question_weights") if src.has(n)],
        ]
    )
    return R.parse_records(df.select(text.alias("value")), "value")


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.size("violations") == 0).drop("violations")


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.size("violations") > 0).select("id", F.inline("violations"))
