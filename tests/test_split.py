"""Text sources in splits that fall anywhere, exact selection, lineage, overlap and state reuse."""

import csv
import io
import json
import math
import random
import re
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.operators import lineage, overlap, selection
from assayer.sources import rows as S
from assayer.sources import split


@pytest.fixture(params=[100, 1 << 20])
def splits(spark, request):
    """Splits of a few bytes put every boundary somewhere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(request.param) if n == names[0] else "0")
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def write(folder, name, text):
    (folder / name).write_bytes(text.encode())
    return str(folder)


def test_lines(spark, splits, tmp_path):
    texts = {"a.txt": "one\n\ntwo\r\nthree é\n", "b.txt": "", "c.txt": "no end", "d e.txt": "\n\n"}
    for name, text in texts.items():
        write(tmp_path, name, text)
    got = {(r.source_file.rsplit("/", 1)[1], r.line): r.value for r in split.numbered_lines(spark, str(tmp_path)).collect()}
    want = {(n.replace(" ", "%20"), i + 1): x for n, t in texts.items() for i, x in enumerate(t.split("\n")[: None if t[-1:] not in ("\n", "") else -1])}
    assert got == want


def test_csv(spark, splits, tmp_path):
    rng = random.Random(4 + splits)
    cells = ["a", '"', ",", "\n", "x y", "", '""', "é", "a long field with words"]
    files = []
    for k in range(2):
        rows = [["".join(rng.choice(cells) for _ in range(rng.randint(0, 4))) for _ in range(3)] for _ in range(8)]
        files.append(rows)
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["c,1", "b", 'q"']] + [r for r in rows])
        write(tmp_path, f"{k}.csv", ("﻿" if k == 1 else "") + out.getvalue())
    got = S.read_delimited(spark, str(tmp_path))
    assert got.columns == ["c,1", "b", 'q"']
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for rows in files for r in rows)


def test_sorted_splits_give_the_same(spark, tmp_path, monkeypatch):
    """Beyond SENT splits the pieces are sorted by split in place of a broadcast."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        monkeypatch.setattr(split, "SENT", 0)
        path = write(tmp_path, "a.json", json.dumps([{"i": i, "s": 'a,"b]' * (i % 4)} for i in range(12)]))
        got = {r.position: json.loads(r.value) for r in S.read_json_array(spark, path).collect()}
        assert got == {i: {"i": i, "s": 'a,"b]' * (i % 4)} for i in range(12)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_arrays(spark, splits, tmp_path):
    rng = random.Random(6)
    marks = ['a', '"', ",", "[", "}", "\\", " ", "\n", "é"]
    files = {}
    for k, indent in enumerate([None, 1, None]):
        files[f"{k}.json"] = [{"k": k, "t": "".join(rng.choice(marks) for _ in range(rng.randint(0, 30))), "n": [[1, {"x": []}], i]} for i in range(5 * (k != 2))]
        write(tmp_path, f"{k}.json", " \n" * k + json.dumps(files[f"{k}.json"], indent=indent) + "\n" * k)
    got = {(r.source_file.rsplit("/", 1)[1], r.position): json.loads(r.value) for r in S.read_json_array(spark, str(tmp_path)).collect()}
    assert got == {(n, i): v for n, rows in files.items() for i, v in enumerate(rows)}


@pytest.mark.parametrize("text", ['[{"a":1},2]', '{"a":1}', '[{"a":1}', '[{"a":1}] x', '[{"a":1},]', '[{"a":1},{"a":1,"a":2}]', '[{"a":NaN}]', '{"a":1}]', '[{"a":1}],[{"a":2}]'])
def test_bad_arrays(spark, tmp_path, text):
    with pytest.raises(Exception, match="no array of objects"):
        S.read_json_array(spark, write(tmp_path, "x.json", text)).collect()


# ---- selection


def test_order_statistics(spark):
    rng = random.Random(7)
    special = [0.0, -0.0, 1e-320, -1e-320, math.inf, -math.inf, 1.0, 1.0, 1.0 + 2**-52, -5.5]
    rows = [(g, v) for g in ("a", "b", None) for v in special + [rng.gauss(0, 10 ** rng.randint(-8, 8)) for _ in range(200)]] + [("a", None), ("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    wishes = [(g, k) for g in ("a", "b", "d") for k in (1, 2, 17, 105, 210, 211)]
    got = {(r.g, r.wish): r.value for r in selection.order_statistics(df, "v", spark.createDataFrame(wishes, "g string, wish long"), ["g"]).collect()}
    want = {}
    for g, k in wishes:
        values = sorted(v for h, v in rows if h == g and v is not None)
        if k <= len(values):
            want[g, k] = values[k - 1]
    assert got == want
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (math.inf,)], "v double")
    assert math.isnan(selection.order_statistics(nan, "v", spark.createDataFrame([(3,)], "wish long")).first().value)


def test_median(spark):
    rows = [(k % 5, float(v * v % 97)) for k in range(5) for v in range(10 * k + 1)] + [(9, None)]
    got = {r.g: r.median for r in selection.median(spark.createDataFrame(rows, "g long, v double"), "v", ["g"]).collect()}
    assert got == {k: statistics.median(v for g, v in rows if g == k) for k in range(5)}
    assert selection.median(spark.createDataFrame([], "v double"), "v").first().median is None


def test_range_bounds(spark):
    df = spark.range(10_000).select((F.col("id") % 997 / 1000.0).alias("v"))
    bounds = selection.range_bounds(df, "v", 16)
    placed = df.withColumn("b", selection.position(bounds, selection.sortable(F.col("v"))))
    sizes = [r["count"] for r in placed.groupBy("b").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 10_000 / 16
    ranges = sorted(tuple(r) for r in placed.groupBy("b").agg(F.min("v"), F.max("v")).collect())
    assert all(a[2] < b[1] for a, b in zip(ranges, ranges[1:]))
    assert selection.range_bounds(df.limit(1), "v", 16) == [] and selection.range_bounds(df, "v", 1) == []


# ---- lineage


def test_lineage(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(i) if i and rng.random() < 0.95 else None, rng.random() < 0.05) for i in range(80)]
    rows += [(1000 + i, 1000 + (i + 1) % 5, False) for i in range(5)] + [(1100 + i, 1000 + i, False) for i in range(5)] + [(1200, 1200, False), (1300, 9999, False)]
    rows += [(3000 + i, 3000 + i - 1 if i else None, False) for i in range(60)] + [(5000 + i, 4999, False) for i in range(60)]
    up = {r: None if own else p for r, p, own in rows}

    def history(r):
        out = []
        while r is not None:
            if r in out:
                return None
            out.append(r)
            r = up.get(r)
        return out

    labels = lineage.interval_labels(spark.createDataFrame(rows, "run long, parent long, self_contained boolean"))
    assert {r.run: r.cyclic for r in labels.collect()} == {r: history(r) is None for r in {*up, 4999, 9999}}
    asked = [r for r in up if r % 3 == 0 and history(r)]
    found = sorted(tuple(r) for r in lineage.ancestors_of(spark.createDataFrame([(r,) for r in asked], "run long"), labels).collect())
    assert found == sorted((r, a) for r in asked for a in history(r))
    weights = spark.createDataFrame([(r, r % 7) for r in up if r % 2], "run long, n long")
    sums = {r.run: r.n for r in lineage.ancestor_sums(labels, weights, ["n"]).collect()}
    assert all(sums[r] == (sum(a % 7 for a in history(r) if a in up and a % 2) if history(r) else None) for r in up)
    with pytest.raises(Exception, match="loop"):
        lineage.ancestors_of(spark.createDataFrame([(1101,)], "run long"), labels).collect()
    with pytest.raises(Exception, match="two parents"):
        lineage.interval_labels(spark.createDataFrame([(1, 2, False), (1, 3, False)], "run long, parent long, self_contained boolean"))


def test_inherited_sources_without_pairs(spark):
    """Every source once per run, absent values too; the join makes no more rows than the result has, and no side is broadcast."""
    n = 400
    runs = spark.createDataFrame([(i, i - 1 if i % n else None, False) for i in range(2 * n)] + [(9000, 9000, False), (9001, 9000, False)], "run long, parent long, self_contained boolean")
    labels = lineage.interval_labels(runs)
    sources = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(2 * n)] * 2 + [(9000, 1), (9999, 1)], "run long, kind long")
    found = lineage.inherited_sources(spark.range(2 * n).selectExpr("id as run"), labels, sources)
    rows = sorted(((r.run, -1 if r.kind is None else r.kind) for r in found.collect()))
    first = lambda kind, chain: next(i for i in range(chain * n, chain * n + n) if i % 3 == kind)
    assert rows == sorted((r, -1 if k == 0 else k) for r in range(2 * n) for k in range(3) if first(k, r // n) <= r)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ancestor" not in plan


def test_loops_keep_their_sources(spark):
    """A run whose history loops is told apart by whether the loop, or a run on the way to it, holds a source."""
    rows = [(i, (i + 1) % 6, False) for i in range(6)] + [(10 + i, 10 + (i + 1) % 5, False) for i in range(5)] + [(20, 12, False), (21, 20, False), (22, 3, False), (30, None, False), (31, 30, False), (32, 31, True)]
    runs = spark.createDataFrame(rows, "run long, parent long, self_contained boolean")
    sources = spark.createDataFrame([(4, "train"), (20, "train"), (31, "train"), (13, "dev")], "run long, split string")
    found = {(r.run, r.cyclic, r.sourced) for r in lineage.incomplete_runs(lineage.interval_labels(runs), runs, sources, "train").collect()}
    loops = {(r, True, True) for r in (*range(6), 20, 21, 22)} | {(r, True, False) for r in range(10, 15)}
    assert found == loops | {(30, False, False), (32, False, False)}


# ---- overlap


def test_overlap(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "The", "of", "x" * 40, "y" * 33 + "z", "é", "B"])
    text = lambda n: rng.choice([" ", "  ", "\n"]).join(word() for _ in range(n))
    texts = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(900, None)]
    items = [(i, text(rng.randint(0, 9))) for i in range(60)] + [(100, None), (101, ""), (None, "a a a a a")]
    grams = lambda t: {tuple(w[i : i + 3]) for w in [[x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^ \t-\r]+", t or "")]] for i in range(len(w) - 2)}
    known = {g for _, t in texts for g in grams(t)}
    want = sorted((str(i), len(grams(t)), len(grams(t) & known)) for i, t in items)
    docs, rows = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(items, "item long, text string")
    for bits in (overlap.MOST_BITS, 1 << 15):
        monkeypatch.setattr(overlap, "MOST_BITS", bits)
        assert sorted((str(r.item), r.grams, r.seen) for r in overlap.text_overlap(rows, docs, "item", n=3).collect()) == want
    plan = overlap.text_overlap(rows, docs, "item", n=3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_arcs_followed_inside_a_task():
    """A chain of neighbouring runs needs no join: one task follows its arcs to the end of the walk, out of the task, or around a loop."""
    def arcs(rows):
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["run", "up", "next_run", "next_up", "dist"])

    down = [(i, False, i + 1, False, 1) if i < 5 else (5, False, 5, True, 1) for i in range(6)]
    up = [(i, True, i - 1, True, 1) if i else (0, True, 0, True, 0) for i in range(6)]
    rows = [r for b in lineage._followed(iter([arcs(down + up)])) for r in b.to_pylist()]
    assert {(r["run"], r["up"]): (r["next_run"], r["dist"], r["state"]) for r in rows} == {
        **{(i, False): (0, 11 - i, lineage.DONE) for i in range(6)}, **{(i, True): (0, i, lineage.DONE) for i in range(6)}}
    rows = [r for b in lineage._followed(iter([arcs([(1, False, 2, False, 1), (2, False, 9, True, 1), (3, False, 3, False, 1)])])) for r in b.to_pylist()]
    assert [(r["next_run"], r["dist"], r["state"]) for r in rows[:2]] == [(9, 2, lineage.OPEN), (9, 1, lineage.OPEN)] and rows[2]["state"] == lineage.LOOP
    assert list(lineage._followed(iter([]))) == []
