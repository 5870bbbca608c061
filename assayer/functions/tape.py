"""Strict JSON in one walk: a structural index over the bytes of an Arrow batch.

Quotes that no backslash escapes split the bytes of all texts into strings and the rest. Brackets, commas, colons, strings and scalars
outside strings are the tokens. Sorted by text, nesting level and place, the tokens of every object and array follow each other, so one look
at a token's number inside its container says what may stand there: that is the grammar of JSON without a stack and without a limit on the
depth. Repeated keys, constants like NaN, text after the value, control characters and bad escapes make a text not strict. A text with a number that
overflows a double is not finite, whether strict or not.

``scanned`` gives the verdict and the members that a shape asks for as nested arrays, in the order of the document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from assayer.session import package_path

PORTION = 1 << 18  # bytes of text scanned at once; each takes about 100 bytes of arrays
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
KINDS = ["null", "string", "boolean", "integer", "float", "array", "object"]
NULL, STRING, BOOLEAN, INTEGER, FLOAT, ARRAY, OBJECT = range(7)


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_BLANK, _MARK, _OPEN, _CLOSE = _set(" \t\r\n"), _set("{}[]:,"), _set("{["), _set("}]")
_ESCAPED, _HEX = _set('"\\/bfnrtu'), _set("0123456789abcdefABCDEF")
_SCALAR = ord("s")
_VALUE = _set('"s{[')


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices begin[i], ..., begin[i] + length[i] - 1, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes between two places as strings."""
    length = end - begin
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[_ranges(begin, length)].tobytes()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 places where they begin. A null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, off - off[0]


def text_ends(column: pa.Array) -> np.ndarray:
    """The n + 1 places where the texts begin, without a copy of the bytes."""
    return np.append(0, np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))


@dataclass
class Shape:
    """Which members are wanted: by name, or "*" for all others and for elements. A member whose shape is None keeps its JSON text."""

    members: dict[str, "Shape | None"] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return 1 + max((s.depth for s in self.members.values() if s), default=0)

    def type(self) -> str:
        return f"array<{_node(self.depth)}>"


def _node(depth: int) -> str:
    below = f",members:array<{_node(depth - 1)}>" if depth > 1 else ""
    return f"struct<key:string,kind:string,json:string,text:string{below}>"


@dataclass
class Scan:
    """Verdicts per text, and the values of strict texts in the order text, level, place."""

    strict: np.ndarray
    finite: np.ndarray
    data: np.ndarray  # without white space outside strings
    row: np.ndarray
    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    key: np.ndarray  # code in ``keys``, or -1
    index: np.ndarray  # inside an array
    keys: pa.Array
    first: np.ndarray  # of a value's members, and how many it has
    count: np.ndarray
    roots: np.ndarray


class _Walk:
    """The token arrays of one portion. ``fail`` marks texts that are not strict."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(data)
        self.bad = np.diff(off) == 0
        self.quotes()
        self.tokens()

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, place, "right") - 1

    def fail(self, place: np.ndarray) -> None:
        if len(place):
            self.bad[self.row_of(place)] = True

    def quotes(self) -> None:
        data, off = self.data, self.off
        quote = np.flatnonzero(data == 0x22)
        slash = np.flatnonzero(data == 0x5C)
        if len(slash):
            # how many backslashes stand before a place, counted inside its text
            opens = np.append(True, (np.diff(slash) > 1) | (np.diff(self.row_of(slash)) > 0))
            run = np.arange(len(slash)) - np.maximum.accumulate(np.where(opens, np.arange(len(slash)), 0))
            starter = run % 2 == 0
            escaped = np.zeros(self.n + 1, dtype=bool)
            escaped[slash[starter] + 1] = True
            escaped[off[off < self.n]] = False
            quote = quote[~escaped[quote]]
        row = self.row_of(quote)
        number = np.arange(len(quote)) - np.searchsorted(quote, off[row])
        opening = number % 2 == 0
        per_row = np.bincount(row, minlength=len(off) - 1)
        self.bad |= per_row % 2 == 1
        self.opens = quote[opening]
        closes = np.append(quote[1:], self.n)[opening]
        self.closes = np.minimum(closes, off[row[opening] + 1] - 1)
        change = np.zeros(self.n + 1, dtype=np.int8)
        change[self.opens] += 1
        np.subtract.at(change, self.closes + 1, 1)
        self.inside = np.cumsum(change[: self.n], dtype=np.int8).astype(bool)
        self.fail(np.flatnonzero(self.inside & (data < 0x20)))
        self.has_escape = np.zeros(len(self.opens), dtype=bool)
        if len(slash):
            first = slash[starter & self.inside[slash]]
            after = np.append(data, np.zeros(6, np.uint8))
            self.fail(first[~_ESCAPED[after[first + 1]]])
            wide = first[after[first + 1] == ord("u")]
            self.fail(wide[~np.all([_HEX[after[wide + k]] for k in range(2, 6)], axis=0)] if len(wide) else wide)
            self.has_escape[np.searchsorted(self.opens, first, "right") - 1] = True

    def tokens(self) -> None:
        data, off = self.data, self.off
        outside = ~self.inside
        blank = outside & _BLANK[data]
        mark = outside & _MARK[data]
        scalar = outside & ~blank & ~mark
        edge = np.zeros(self.n + 1, dtype=bool)
        edge[off] = True
        begins = scalar & (np.append(True, ~scalar[:-1]) | edge[:-1])
        ends = scalar & (np.append(~scalar[1:], True) | edge[1:])
        kind = np.where(mark, data, 0)
        kind[self.opens] = 0x22
        kind[begins] = _SCALAR
        at = np.flatnonzero(kind)
        self.scalar_end = np.flatnonzero(ends) + 1
        # white space goes; what stays has new places
        self.place = np.append(0, np.cumsum(~blank))
        self.kept = data[~blank]
        row = self.row_of(at)
        kind = kind[at]
        step = np.where(_OPEN[kind], 1, np.where(_CLOSE[kind], -1, 0))
        total = np.append(0, np.cumsum(step))
        base = total[np.searchsorted(at, off[:-1])]
        level = total[:-1] - base[row]  # before the token
        self.bad[row[(level + step) < 0]] = True
        self.bad |= (total[np.searchsorted(at, off[1:])] != base) | (np.bincount(row, minlength=len(base)) == 0)
        good = ~self.bad[row]
        self.at, self.kind, self.row, self.level = at[good], kind[good], row[good], level[good]

    def containers(self) -> None:
        """Sort tokens by text, level and place; an opening bracket also opens its container one level deeper."""
        n = len(self.at)
        opening = np.flatnonzero(_OPEN[self.kind])
        token = np.concatenate([np.arange(n), opening])
        marker = np.arange(len(token)) >= n
        level = self.level[token] + marker
        order = np.lexsort((token, level, self.row[token]))
        token, marker, level = token[order], marker[order], level[order]
        row = self.row[token]
        top = (level == 0) & (np.append(-1, row[:-1]) != row)
        number = np.arange(len(token))
        start = np.maximum.accumulate(np.where(marker | top, number, 0)) if len(token) else number
        holder = np.where(marker[start], token[start], -1)  # the token that opened the container
        place = number - start + np.where(marker[start], 0, 1)
        kind = self.kind[token]
        around = np.where(holder >= 0, self.kind[np.maximum(holder, 0)], 0)
        value, closes = _VALUE[kind], _CLOSE[kind]
        in_array = np.where(closes, (kind == ord("]")) & ((place == 1) | (place % 2 == 0)), np.where(place % 2 == 1, value, kind == ord(",")))
        quarter = place % 4
        in_object = np.where(
            closes, (kind == ord("}")) & ((place == 1) | (quarter == 0)),
            np.select([quarter == 1, quarter == 2, quarter == 3], [kind == 0x22, kind == ord(":"), value], kind == ord(",")),
        )
        fits = np.select([around == ord("["), around == ord("{")], [in_array, in_object], (place == 1) & value)
        self.bad[row[~fits & ~marker]] = True
        self.token, self.marker, self.holder, self.place_in, self.around = token, marker, holder, place, around


def _literals(walk: _Walk) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of the scalars (-1: none), and whether each stays finite."""
    own = np.flatnonzero(walk.kind == _SCALAR)
    begin = walk.at[own]
    end = walk.scalar_end[np.searchsorted(walk.scalar_end, begin, "right")]
    texts = _strings(walk.data, begin, end)
    number = pc.match_substring_regex(texts, NUMBER).to_numpy(zero_copy_only=False)
    broken = pc.match_substring_regex(texts, r"[.eE]").to_numpy(zero_copy_only=False)
    kind = np.where(number, np.where(broken, FLOAT, INTEGER), -1)
    for word, code in (("true", BOOLEAN), ("false", BOOLEAN), ("null", NULL)):
        kind[pc.equal(texts, word).to_numpy(zero_copy_only=False)] = code
    finite = np.ones(len(own), dtype=bool)
    wide = (kind == FLOAT) & (pc.match_substring_regex(texts, "[eE]").to_numpy(zero_copy_only=False) | (end - begin > 300))
    for k in np.flatnonzero(wide).tolist():
        finite[k] = abs(float(texts[k].as_py())) != float("inf")
    walk.bad[walk.row[own[kind < 0]]] = True
    code = np.full(len(walk.at), -1)
    code[own] = kind
    return code, walk.row[own[~finite]]


def scan(data: np.ndarray, off: np.ndarray) -> Scan:
    walk = _Walk(data, off)
    walk.containers()
    code, overflow = _literals(walk)
    code = np.where(walk.kind == 0x22, STRING, np.where(walk.kind == ord("["), ARRAY, np.where(walk.kind == ord("{"), OBJECT, code)))
    token, place, around = walk.token, walk.place_in, walk.around
    # where each token's text ends
    end = np.zeros(len(walk.at), dtype=np.int64)
    string = np.flatnonzero(walk.kind == 0x22)
    which = np.searchsorted(walk.opens, walk.at[string])
    end[string] = walk.closes[which] + 1
    own = np.flatnonzero(walk.kind == _SCALAR)
    end[own] = walk.scalar_end[np.searchsorted(walk.scalar_end, walk.at[own], "right")]
    escape = np.zeros(len(walk.at), dtype=bool)
    escape[string] = walk.has_escape[which]
    last = np.flatnonzero(_CLOSE[walk.kind[token]] & ~walk.marker)
    shut = walk.holder[last] >= 0
    end[walk.holder[last[shut]]] = walk.at[token[last[shut]]] + 1
    # keys: equal ones share a code
    is_key = ~walk.marker & (around == ord("{")) & (place % 4 == 1) & (walk.kind[token] == 0x22) & ~walk.bad[walk.row[token]]
    keyed = np.flatnonzero(is_key)
    names = _strings(walk.data, walk.at[token[keyed]] + 1, end[token[keyed]] - 1)
    names = _unescaped(names, escape[token[keyed]])
    coded = names.dictionary_encode()
    key_code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(names) else np.zeros(0, np.int64)
    pair = walk.holder[keyed].astype(np.int64) * max(1, len(coded.dictionary)) + key_code
    order = np.argsort(pair, kind="stable")
    again = np.flatnonzero(pair[order][1:] == pair[order][:-1])
    walk.bad[walk.row[token[keyed[order[again + 1]]]]] = True
    # values
    value = np.where(around == ord("{"), place % 4 == 3, np.where(around == ord("["), place % 2 == 1, place == 1))
    value = np.flatnonzero(value & ~walk.marker & _VALUE[walk.kind[token]] & ~walk.bad[walk.row[token]])
    at = token[value]
    key = np.full(len(token), -1)
    key[keyed] = key_code
    inner = around[value] == ord("{")
    holder = walk.holder[value]
    cut = np.append(-2, holder[:-1]) != holder
    first_of, count_of = np.zeros(len(walk.at) + 1, dtype=np.int64), np.zeros(len(walk.at) + 1, dtype=np.int64)
    begins = np.flatnonzero(cut)
    first_of[holder[begins]] = begins
    count_of[holder[begins]] = np.diff(np.append(begins, len(value)))
    strict, finite = ~walk.bad, np.ones(len(off) - 1, dtype=bool)
    finite[overflow] = False
    return Scan(
        strict, finite, walk.kept, walk.row[at], code[at], walk.place[walk.at[at]], walk.place[end[at]],
        np.where(inner, key[np.maximum(value - 2, 0)], -1), (place[value] - 1) // 2, coded.dictionary,
        first_of[at], np.where(code[at] >= ARRAY, count_of[at], 0), np.flatnonzero(holder < 0),
    )


def _unescaped(texts: pa.Array, escape: np.ndarray) -> pa.Array:
    """The contents of string literals. A lone surrogate becomes the replacement character."""
    which = np.flatnonzero(escape)
    if not len(which):
        return texts
    plain = [json.loads(f'"{texts[k].as_py()}"', strict=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace") for k in which.tolist()]
    return pc.replace_with_mask(texts, pa.array(escape), pa.array(plain, pa.string()))


def _level(found: Scan, nodes: np.ndarray, shapes: list[Shape | None], own: np.ndarray, depth: int) -> pa.Array:
    """The structs of ``nodes``, whose shapes are ``shapes[own]``, with ``depth - 1`` levels of members below."""
    kind, begin, end = found.kind[nodes], found.begin[nodes], found.end[nodes]
    code, index = found.key[nodes], found.index[nodes]
    key = found.keys.take(pa.array(code, mask=code < 0)) if len(found.keys) else pa.nulls(len(nodes), pa.string())
    if (code < 0).any():
        key = pc.if_else(pa.array(code < 0), pa.array(index).cast(pa.string()), key)
    wanted = np.array([s is not None for s in shapes])[own] & (kind >= ARRAY)
    texts = _masked(found.data, begin, end, wanted)
    string = kind == STRING
    inside = _masked(found.data, begin + string, end - string, ~string)
    escape = pc.match_substring(inside, "\\").fill_null(False).to_numpy(zero_copy_only=False) if string.any() else np.zeros(len(nodes), bool)
    inside = _unescaped(inside, escape)
    kinds = pa.array(KINDS).take(pa.array(kind))
    columns, names = [key, kinds, texts, inside], ["key", "kind", "json", "text"]
    if depth > 1:
        count = np.where(wanted, found.count[nodes], 0)
        below = _ranges(found.first[nodes], count)
        holder = np.repeat(np.arange(len(nodes)), count)
        lists: list[Shape | None] = [None]
        shape = np.zeros(len(below), dtype=np.int64)
        names_of = {name: k for k, name in enumerate(found.keys.to_pylist())} if len(below) else {}
        for k, s in enumerate(shapes):
            mine = own[holder] == k
            if s is None or not mine.any():
                continue
            table = np.full(len(names_of) + 1, _entry(lists, s.members["*"]) if "*" in s.members else -1)
            for name, child in s.members.items():
                if name in names_of:
                    table[names_of[name]] = _entry(lists, child)
            shape[mine] = table[found.key[below[mine]]]
        below, holder, shape = below[shape >= 0], holder[shape >= 0], shape[shape >= 0]
        count = np.bincount(holder, minlength=len(nodes))
        members = _level(found, below, lists, shape, depth - 1)
        offsets = np.append(0, np.cumsum(count)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), members))
        names.append("members")
    return pa.StructArray.from_arrays(columns, names)


def _entry(lists: list, shape: Shape | None) -> int:
    if shape is None:
        return 0
    lists.append(shape)
    return len(lists) - 1


def _masked(data: np.ndarray, begin: np.ndarray, end: np.ndarray, absent: np.ndarray) -> pa.Array:
    texts = _strings(data, begin, np.where(absent, begin, end))
    return pc.if_else(pa.array(absent), pa.scalar(None, pa.string()), texts) if absent.any() else texts


def _portions(column: pa.Array) -> Iterator[pa.Array]:
    off = text_ends(column)
    at = 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(off, off[at] + PORTION, "right")) - 1))
        yield column.slice(at, to - at)
        at = to


def scan_column(column: pa.Array, shape: Shape | None) -> pa.Array:
    """One struct per text: strict, finite, kind and, with a shape, the members that it asks for."""
    parts = []
    for texts in _portions(column):
        found = scan(*text_bytes(texts))
        n = len(texts)
        node = np.full(n, -1)
        node[found.row[found.roots]] = found.roots
        absent = pa.array(node < 0)
        kind = pc.if_else(absent, pa.scalar(None, pa.string()), pa.array(KINDS).take(pa.array(np.where(node < 0, 0, found.kind[node] if len(found.kind) else 0))))
        columns, names = [pa.array(found.strict), pa.array(found.finite), kind], ["strict", "finite", "kind"]
        if shape is not None:
            roots = found.roots
            inner = _level(found, roots, [shape], np.zeros(len(roots), dtype=np.int64), shape.depth + 1)
            lists = inner.field("members")
            size = np.zeros(n, dtype=np.int64)
            size[found.row[roots]] = np.diff(lists.offsets.to_numpy())
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), lists.values))
            names.append("members")
        parts.append(pa.StructArray.from_arrays(columns, names))
    if not parts:
        return scan_column(pa.array([""]), shape).slice(0, 0)
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def number_leaves(column: pa.Array) -> pa.Array:
    """The numbers of objects in objects, however deep, with their keys joined by "/", in the order of each text."""
    parts = []
    for texts in _portions(column):
        found = scan(*text_bytes(texts))
        level = found.roots[found.kind[found.roots] == OBJECT]
        names = pa.array([""] * len(level), pa.string())
        nodes, paths = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
        first = True
        while len(level):
            count = found.count[level]
            below = _ranges(found.first[level], count)
            kind = found.kind[below]
            kept = np.flatnonzero((kind == OBJECT) | (kind == INTEGER) | (kind == FLOAT))
            holder = np.repeat(np.arange(len(level)), count)[kept]
            below, kind = below[kept], kind[kept]
            keys = found.keys.take(pa.array(found.key[below]))
            names = keys if first else pc.binary_join_element_wise(names.take(pa.array(holder)), keys, "/")
            first = False
            number = kind != OBJECT
            nodes.append(below[number])
            paths.append(names.filter(pa.array(number)))
            level, names = below[~number], names.filter(pa.array(~number))
        node, path = np.concatenate(nodes), pa.concat_arrays([x.cast(pa.string()) for x in paths])
        order = np.lexsort((found.begin[node], found.row[node]))
        node, path = node[order], path.take(pa.array(order))
        texts_of = _strings(found.data, found.begin[node], found.end[node])
        try:
            value = pc.cast(texts_of, pa.float64())
        except pa.ArrowInvalid:  # a number beyond the doubles
            value = pa.array([float(x) for x in texts_of.to_pylist()], pa.float64())
        offsets = np.searchsorted(found.row[node], np.arange(len(texts) + 1)).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([path, value], ["name", "value"])))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("name", pa.string()), ("value", pa.float64())])))


def objects_named(column: pa.Array, name: str) -> pa.Array:
    """The compact texts of all objects under the key ``name``, at any depth, in the order of each text; those inside another one are part of it."""
    parts = []
    for texts in _portions(column):
        found = scan(*text_bytes(texts))
        wanted = pc.equal(found.keys, name).to_numpy(zero_copy_only=False) if len(found.keys) else np.zeros(0, bool)
        node = np.flatnonzero((found.kind == OBJECT) & (found.key >= 0) & np.append(wanted, False)[found.key])
        node = node[np.lexsort((found.begin[node], found.row[node]))]
        if len(node):
            before = np.append(-1, np.maximum.accumulate(found.end[node])[:-1])
            node = node[found.begin[node] >= before]
        offsets = np.searchsorted(found.row[node], np.arange(len(texts) + 1)).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), _strings(found.data, found.begin[node], found.end[node])))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def _column(text: Column, kind: str, work, **options) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return work(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, **options)

    spark = SparkSession.getActiveSession()
    if spark is not None:
        package_path(spark)
    return F.arrow_udf(run, kind)(text)


def scanned(text: Column, shape: Shape | None = None) -> Column:
    """STRUCT<strict, finite, kind[, members]> of a JSON text; a NULL or empty text is not strict, and only strict texts have a kind and members.
    Members follow ``shape``: an object or array with a shape of its own carries its members in place of JSON text, any other value its compact
    text; ``text`` is the content of a string. Elements of an array have their index as key. Where there are no members the array is empty."""
    kind = "struct<strict:boolean,finite:boolean,kind:string" + (f",members:{shape.type()}" if shape is not None else "") + ">"
    return _column(text, kind, scan_column, shape=shape)


def numeric_leaves(text: Column) -> Column:
    """ARRAY<STRUCT<name, value>>: the numbers of nested objects at any depth, named by their keys joined by "/". Booleans, strings and arrays are
    skipped; a text that is no strict JSON object has none."""
    return _column(text, "array<struct<name:string,value:double>>", number_leaves)


def named_objects(text: Column, name: str) -> Column:
    """ARRAY<STRING>: the objects under the key ``name`` anywhere in a strict JSON text, outermost ones only, as compact texts."""
    return _column(text, "array<string>", objects_named, name=name)
