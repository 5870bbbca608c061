"""Strict JSON in one walk, against the standard library."""

import json
import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions import tape as T


def unique(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError
    return dict(pairs)


def refuse(constant):
    raise ValueError(constant)


def loads(text):
    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


def finite(v):
    if isinstance(v, float):
        return math.isfinite(v)
    return all(map(finite, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else True


def kind(v):
    names = {type(None): "null", bool: "boolean", str: "string", int: "integer", float: "float", list: "array", dict: "object"}
    return names[type(v)]


BROKEN = [
    None, "", "  ", "{}", "[]", " [ ] ", "[1 2]", "[1,]", "{,}", '{"a":1,}', '{"a" 1}', '{"a":}', "nul", "NaN", "-Infinity", "[1e999]", "-", "01", "1.", ".5", "1e5",
    '"a', '"\\x"', '"\\u12G4"', '{"a":1,"\\u0061":2}', '"\t"', "[[]", "[]]", "{]", "[}", "{} {}", "1 2", '["a""b"]', "tru e", "\\", '"\\\\"', '"\\\\\\"', "[1,,2]",
    '{"a":{"b":1,"b":2}}', "[\x0b1]", "[1]\x00", '"\x7f"', "-0", "-0.0", "1E+5", "{1:2}", '{"a":1 "b":2}', "[:]", "[1:2]", '{"a",1}', '"abc\\"', '["\\""]', "[1e-999]",
]


def value(rng, depth):
    r = rng.random()
    if depth <= 0 or r < 0.4:
        return rng.choice([1, -2.5, "a", 'q"\\/\né', True, False, None, 1e300, "", 0, "\\", " x y ", "😀", 12345678901234567890123])
    if r < 0.7:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice('abcdefg"\\é') + str(rng.randint(0, 3)): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}


@pytest.fixture(scope="module")
def texts():
    """Valid texts and texts with a letter or two changed."""
    rng = random.Random(5)
    out = list(BROKEN)
    for _ in range(4000):
        t = json.dumps(value(rng, 4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))
        for _ in range(rng.choice([0, 1, 2])):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", '"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "1", "e", ".", "-", "a", "null"]) + t[i + rng.randint(0, 1) :]
        out.append(t)
    return out


def parsed(text):
    try:
        return True, loads(text or "")
    except ValueError:
        return False, None


def same(node, v, depth):
    if isinstance(v, (dict, list)) and depth:
        items = list(v.items()) if isinstance(v, dict) else [(str(i), x) for i, x in enumerate(v)]
        assert node["json"] is None and [m["key"] for m in node["members"]] == [k for k, _ in items]
        for m, (_, x) in zip(node["members"], items):
            same(m, x, depth - 1)
    else:
        assert json.loads(node["json"]) == v and node["kind"] == kind(v) and not node.get("members")
        assert node["text"] == (v if isinstance(v, str) else None)


@pytest.mark.parametrize("portion", [1, 1 << 21])
def test_scan(texts, portion, monkeypatch):
    monkeypatch.setattr(T, "PORTION", portion)
    shape = T.Shape({"*": T.Shape({"*": None})})
    for text, got in zip(texts, T.scan_column(pa.array(texts, pa.string()), shape).to_pylist()):
        strict, v = parsed(text)
        assert got["strict"] == strict, text
        if strict:
            assert (got["kind"], got["finite"]) == (kind(v), finite(v))
            items = list(v.items()) if isinstance(v, dict) else [(str(i), x) for i, x in enumerate(v)] if isinstance(v, list) else []
            assert [m["key"] for m in got["members"]] == [k for k, _ in items]
            for m, (_, x) in zip(got["members"], items):
                same(m, x, 1)
        else:
            assert got["kind"] is None and got["members"] == []


def test_shape_drops_other_members():
    shape = T.Shape({"a": None, "b": T.Shape({"c": None})})
    got = T.scan_column(pa.array(['{"x":1,"b":{"c":[1, 2],"d":2},"a":"q"}', '{"b":3}', "[1]"]), shape).to_pylist()
    assert [[m["key"] for m in g["members"]] for g in got] == [["b", "a"], ["b"], []]
    assert [(m["key"], m["json"]) for m in got[0]["members"][0]["members"]] == [("c", "[1,2]")]
    assert got[1]["members"][0]["json"] == "3"


def leaves(v, path=()):
    for k, x in v.items():
        if isinstance(x, dict):
            yield from leaves(x, (*path, k))
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            yield "/".join((*path, k)), float(x)


def under(v, name):
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        if k == name and isinstance(x, dict):
            yield x
        else:
            yield from under(x, name)


def test_walks(texts):
    numbers, objects = (f(pa.array(texts, pa.string())).to_pylist() for f in (T.number_leaves, lambda c: T.objects_named(c, "a1")))
    for text, got, found in zip(texts, numbers, objects):
        strict, v = parsed(text)
        assert [(x["name"], x["value"]) for x in got] == (list(leaves(v)) if strict and isinstance(v, dict) else [])
        assert [json.loads(x) for x in found] == (list(under(v, "a1")) if strict else [])


def test_any_depth(spark):
    deep = "[" * 5000 + "]" * 5000
    rows = spark.createDataFrame([(1, deep), (2, deep + "]"), (3, deep[:-1] + "}"), (4, None), (5, '{"a":' * 3000 + "1.5" + "}" * 3000)], "id long, t string")
    got = {r.id: r for r in rows.select("id", T.scanned(F.col("t")).alias("s"), T.numeric_leaves(F.col("t")).alias("n")).collect()}
    assert [got[i].s.strict for i in range(1, 6)] == [True, False, False, False, True]
    assert got[5].n[0].name.count("/") == 2999 and got[5].n[0].value == 1.5
    assert rows.limit(0).select(T.scanned(F.col("t"), T.Shape({"*": None})).alias("s"), T.numeric_leaves(F.col("t"))).count() == 0


def test_scan_memory_follows_the_portion():
    """A batch of many texts is scanned in portions: the arrays beside the result stay small, and the portions change nothing."""
    texts = pa.array(['{"a":[%d,{"b":"x y"},null],"c":{"d":1.5e3}}' % i for i in range(60_000)])
    shape = T.Shape({"*": None})
    T.scan_column(texts.slice(0, 10), shape)
    tracemalloc.start()
    whole = T.scan_column(texts, shape)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert whole.slice(31_000, 50).to_pylist() == T.scan_column(texts.slice(31_000, 50), shape).to_pylist()
    assert list(T.text_ends(pa.array(["ab", None, "", "é"]).slice(1))) == [0, 0, 0, 2]
