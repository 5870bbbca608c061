"""JSON checks and views as Spark expressions: strictness, ordered entries, kinds.

``strict`` and ``finite`` come from one walk over the bytes (``functions.tape``); whole records are read there as well. The views here work on single
values: VARIANT sorts object keys and rounds number spellings, so it decides kinds and values while the text (MAP<STRING,STRING>
keeps the order of the document) decides order and wording.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.tape import scanned


def let(value: Column, fn) -> Column:
    """Evaluate a value once and use it several times inside an expression."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strict(text: Column) -> Column:
    """True when the text is one JSON value with unique keys and no NaN/Infinity constants; False for NULL."""
    return scanned(text)["strict"]


def finite(text: Column) -> Column:
    """True when no number of a JSON text overflows a double."""
    return scanned(text)["finite"]


MEMBER = "array<struct<key:string,kind:string,json:string,text:string>>"
ITEM = "array<struct<kind:string,json:string,text:string>>"


def json_kind(text: Column) -> Column:
    """null, string, boolean, integer, float, array or object, from the start of a JSON text."""
    first = F.substring(text, 1, 1)
    return (
        F.when(first == '"', "string")
        .when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == "n", "null")
        .when(first.isin("t", "f"), "boolean")
        .when(text.rlike("[.eE]"), "float")
        .otherwise("integer")
    )


def kind(value: Column) -> Column:
    """Kind of a VARIANT."""
    return F.coalesce(let(F.to_json(value), lambda t: F.when(t.isNotNull(), json_kind(t))), F.lit("null"))


def quote(text: Column) -> Column:
    """A string as a JSON literal."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def _member(raw: Column, value: Column) -> list[Column]:
    """kind, json and text of one value. Nested values keep the wording of the document."""
    plain = F.coalesce(F.to_json(value), F.lit("null"))

    def named(t: Column) -> Column:
        nested = F.substring(t, 1, 1).isin("{", "[")
        return F.struct(
            json_kind(t).alias("kind"), F.when(nested, raw).otherwise(t).alias("json"), raw.alias("text")
        )

    return let(plain, named)


def entries(text: Column) -> Column:
    """The members of a JSON object in document order: ARRAY<STRUCT<key, kind, json, text>>.

    ``json`` is the member's compact text (nested objects keep their key order), ``text`` the same
    without quotes for a string.
    """
    raw = F.map_entries(F.from_json(text, "map<string,string>"))
    typed = F.map_entries(F.from_json(text, "map<string,variant>"))

    def member_of(r: Column, t: Column) -> Column:
        return let(
            _member(r["value"], t["value"]),
            lambda m: F.struct(r["key"].alias("key"), m["kind"].alias("kind"), m["json"].alias("json"),
                               m["text"].alias("text")),
        )

    return F.zip_with(raw, typed, member_of).cast(MEMBER)


def items(text: Column) -> Column:
    """The elements of a JSON array: ARRAY<STRUCT<kind, json, text>>."""
    raw = F.from_json(text, "array<string>")
    typed = F.from_json(text, "array<variant>")
    return F.zip_with(raw, typed, _member).cast(ITEM)


def text_kind(text: Column) -> Column:
    """Kind of a strict JSON text; NULL text is "absent"."""
    return F.when(text.isNull(), "absent").otherwise(json_kind(F.ltrim(text, F.lit(" \t\r\n"))))


def member(members: Column, name: str) -> Column:
    """JSON text of one member, NULL when absent."""
    return F.get(F.filter(members, lambda e: e["key"] == name), F.lit(0))["json"]


def object_of(pairs: list[tuple[str, Column]]) -> Column:
    """Compact JSON object with fixed names; members are JSON texts, NULL members are left out."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in pairs]
    body = F.concat_ws(",", *parts)
    return F.concat(F.lit("{"), body, F.lit("}"))


def object_from(keys: Column, texts: Column) -> Column:
    """Compact JSON object from ordered keys and JSON texts."""
    pairs = F.zip_with(keys, texts, lambda k, v: F.concat(quote(k), F.lit(":"), v))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def array_of(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def canonical(text: Column) -> Column:
    """Compact text with sorted keys and normal number spellings, the form that is digested."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    """First 20 hex digits of the sha256 of the canonical text."""
    return F.substring(F.sha2(canonical(text), 256), 1, 20)
