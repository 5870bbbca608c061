"""Strict JSON, one accepted and one rejected row per rule, adapters, packing and sources."""

import base64
import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import json as J
from assayer.operators import adapters as A
from assayer.operators import leakage as K
from assayer.operators import records as R
from assayer.operators import tokens as T
from assayer.operators import validate as V
from assayer.plans import fixtures
from assayer.sources import packed as P
from assayer.sources import rows as S

GOOD = {
    "schema_version": "judgment-sft-v1", "id": "r:1", "task_id": "t",
    "request": {
        "state": {"message": "broken screen", "n": [1, 2.5, None]},
        "questions": {
            "z": {"type": "noul", "instructions": "ok?"},
            "pick": {"type": "choice", "criteria": {"zoo": "Z", "art": None, "mid": {"a": [1]}}},
            "level": {"type": "score", "criteria": ["low", {"d": 1}, ["high"]]},
        },
    },
    "targets": {
        "z": {"kind": "bernoulli", "p_true": 1},
        "pick": {"kind": "distribution", "values": {"art": 0.5, "zoo": 0.25, "mid": 0.25}},
        "level": {"kind": "class", "value": "2"},
    },
    "metadata": {"split_group": "g"}, "weight": 2, "question_weights": {"z": 3},
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for key in path[:-1]:
        at = at[key]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


BAD = {
    "unknown_fields": [(["extra"], 1), (["request", "x"], 1), (["request", "questions", "z", "x"], 1),
                       (["targets", "level", "x"], 1)],
    "schema_version": [(["schema_version"], "v2"), (["schema_version"], KeyError)],
    "id": [(["id"], ""), (["id"], 7)], "task_id": [(["task_id"], None)],
    "metadata": [(["metadata"], [])], "weight": [(["weight"], True), (["weight"], "2"), (["weight"], 0)],
    "state": [(["request", "state"], 5), (["request", "state"], None), (["request", "state"], KeyError)],
    "model": [(["request", "model"], 1)],
    "images": [(["request", "images"], ["x"]), (["request", "images"], "x"),
               (["request", "images"], ["data:image/gif;base64,AAAA"])],
    "questions": [(["request", "questions"], {}), (["request", "questions"], [])],
    "question_id": [(["request", "questions", ""], {"type": "noul"})],
    "object": [(["request", "questions", "z"], 1), (["targets", "level"], 1)],
    "instructions": [(["request", "questions", "z", "instructions"], 5)],
    "choice_options": [(["request", "questions", "pick", "criteria"], {}), (["request", "questions", "pick", "criteria"], ["a"]),
                       (["request", "questions", "pick", "criteria"], {str(i): "" for i in range(256)})],
    "choice_option": [(["request", "questions", "pick", "criteria", ""], "e"), (["request", "questions", "pick", "criteria", "zoo"], 5)],
    "score_levels": [(["request", "questions", "level", "criteria"], ["a"]), (["request", "questions", "level", "criteria"], ["a"] * 11)],
    "score_description": [(["request", "questions", "level", "criteria"], ["a", None, "c"])],
    "noul_keys": [(["request", "questions", "z", "criteria"], {"maybe": "x"})],
    "noul_description": [(["request", "questions", "z", "criteria"], {"true": 1})],
    "unknown_type": [(["request", "questions", "z", "type"], "rank")],
    "noul_target": [(["targets", "z"], {"kind": "class", "value": "true"}), (["targets", "z"], {"kind": "bernoulli"})],
    "probability": [(["targets", "z", "p_true"], 1.5), (["targets", "z", "p_true"], True), (["targets", "z", "p_true"], "1"),
                    (["targets", "pick", "values"], {"art": 1.5, "zoo": -0.25, "mid": -0.25})],
    "target_kind": [(["targets", "level"], {"kind": "rank"})],
    "class_value": [(["targets", "level", "value"], "3"), (["targets", "level", "value"], 2)],
    "distribution_keys": [(["targets", "pick", "values"], {"art": 0.5, "zoo": 0.5})],
    "distribution_sum": [(["targets", "pick", "values"], {"art": 0.5, "zoo": 0.25, "mid": 0.15})],
    "allowed_set": [(["targets", "pick"], {"kind": "allowed_set", "values": []})],
    "allowed_outcome": [(["targets", "pick"], {"kind": "allowed_set", "values": ["art", "art"]}),
                        (["targets", "pick"], {"kind": "allowed_set", "values": ["none"]})],
    "targets": [(["targets"], {}), (["targets", "ghost"], {"kind": "bernoulli", "p_true": 1})],
    "question_weights": [(["question_weights"], {"other": 1})],
    "question_weight": [(["question_weights"], {"z": 0}), (["question_weights"], {"z": "1"})],
}


def test_rules(spark):
    rows = [("", json.dumps(GOOD))]
    rows.append(("", json.dumps(changed(["request", "questions", "z", "criteria"], {"true": "yes", "false": None}))))
    rows.append(("", json.dumps(changed(["targets", "pick"], {"kind": "allowed_set", "values": ["art", "zoo"]}))))
    rows.append(("", json.dumps(changed(["question_weights"], KeyError))))
    rows += [(rule, json.dumps(changed(p, v))) for rule, cases in BAD.items() for p, v in cases]
    df = spark.createDataFrame(rows, "want string, value string").repartition(8)
    for r in V.validated(R.parse_records(df, "value")).select("want", "value", "violations").collect():
        got = {v["rule"] for v in r["violations"]}
        assert (r["want"] in got) if r["want"] else not got, (r["want"], got, r["value"])


def test_parse_keeps_order_and_weights(spark):
    df = R.parse_records(spark.createDataFrame([(json.dumps(GOOD),)], "value string"), "value")
    q = {r["qid"]: r for r in R.exploded_questions(df).collect()}
    assert q["pick"]["keys"] == ["zoo", "art", "mid"] and q["pick"]["dist"] == [0.25, 0.5, 0.25]
    assert q["level"]["keys"] == ["0", "1", "2"] and q["level"]["value"] == "2"
    assert q["z"]["weight"] == pytest.approx(2 * 3 / 5)
    text = df.select(R.record_json(df).alias("j")).first()["j"]
    assert json.loads(text) == json.loads(json.dumps(GOOD))
    assert list(json.loads(text)["request"]["questions"]["pick"]["criteria"]) == ["zoo", "art", "mid"]
    inputs = json.loads(df.select(R.model_inputs(df).alias("j")).first()["j"])
    assert set(inputs) == {"state", "questions"} and len(inputs["questions"]) == 3
    kept = df.select(R.supervised_request(df)["questions"].alias("q")).first()["q"]
    assert [x["qid"] for x in kept] == ["z", "pick", "level"]


def _reference_verdict(text):
    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError
        return dict(pairs)

    def refuse(_):
        raise ValueError

    try:
        json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
        return True
    except ValueError:
        return False


def test_strict_json_on_damaged_texts(spark):
    rng = random.Random(5)
    base = json.dumps(GOOD)
    texts = ["null", "1 2", "[]", "{}", '{"a":1}]', '{"a":1}}', "[1],[2]", '{"a":{"b":1,"b":2}}', "NaN", '"x"', "01", " [1] "]
    for _ in range(300):
        i = rng.randrange(len(base))
        mode = rng.randrange(4)
        texts.append(
            base[:i] + base[i + 1:] if mode == 0 else base[:i] + rng.choice('{}[],:"19') + base[i:] if mode == 1
            else base[:i] if mode == 2 else base + base[i:]
        )
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", J.strict(F.col("t")).alias("s")).collect():
        assert r["s"] == _reference_verdict(r["t"]), r["t"]


def test_adapters_fail_on_bad_configuration(spark):
    df = spark.createDataFrame([("t", [0.5, 0.5])], "text string, probabilities array<double>")
    q = {"type": "choice", "criteria": {"a": None, "b": None}}
    with pytest.raises(A.ConfigError, match="missing source column"):
        A.normalize(df, {"adapter": "classification", "question": q}, "t")
    with pytest.raises(A.ConfigError, match="probability_order"):
        A.normalize(df, {"adapter": "classification", "question": q, "target_kind": "distribution"}, "t")
    with pytest.raises(A.ConfigError, match="unsupported adapter"):
        A.normalize(df, {"adapter": "other"}, "t")
    native = A.normalize(spark.createDataFrame([(json.dumps(GOOD),)], "value string"), {"adapter": "native"}, "t")
    assert native.select("violations").first()["violations"] == []
    parts = spark.createDataFrame([(json.dumps(GOOD["request"]), json.dumps(GOOD["targets"]))], "request string, targets string")
    row = A.normalize(parts, {"adapter": "native"}, "t").first()
    assert row["violations"] == [] and row["split_group_inferred"] and row["id"].startswith("t:")


def test_pack_and_unpack_with_views(spark):
    url = lambda b: "data:image/png;base64," + base64.b64encode(b).decode()
    record = changed(["request", "images"], [url(b"a"), url(b"bb")])
    view = {"view_id": "v", "request": copy.deepcopy(record["request"]), "equivalence": {
        "verified": True, "relation": "same_conditional_task", "method": "m", "reference": "r", "readout_scope": "all_readouts"}}
    view["request"]["images"] = [url(b"ccc")]
    record["views"] = [view]
    rows = R.parse_records(spark.createDataFrame([(json.dumps(record),), (json.dumps(changed(["id"], "r:2")),)], "value string"), "value")
    packed = P.pack(rows)
    got = {r["id"]: r for r in P.unpack(P.packed_problem(packed.drop("problem"))).collect()}
    assert [bytes(i["bytes"]) for i in got["r:1"]["images"]] == [b"a", b"bb", b"ccc"] and got["r:2"]["images"] == []
    assert got["r:1"]["problem"] is None and json.loads(got["r:1"]["value"]) == record


def test_files_and_published_versions(spark, tmp_path):
    pictures = tmp_path / "pictures"
    pictures.mkdir()
    (pictures / "two.doc").write_bytes(b"?")
    (pictures / "one.png").write_bytes(b"\x89PNG\r\n\x1a\nbody")
    rows = spark.createDataFrame([("a", "one.png"), ("b", "none.png"), ("c", "x/one.png"), ("d", f"{pictures}/./one.png"), ("e", "two.doc")], "id string, image_path string")
    got = {r["id"]: r for r in P.embed_files(rows, spark, str(pictures)).collect()}
    assert got["a"]["image"].startswith("data:image/png;base64,") and got["d"]["image"] == got["a"]["image"]
    assert [got[i]["image_problem"] for i in "abcde"] == [None, "no_such_file", "no_such_file", None, "unknown_image_type"]
    swapped = tmp_path / "swapped"
    swapped.mkdir()
    (swapped / "1.csv").write_text("a,b\n1,2\n")
    (swapped / "2.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception):
        S.read_delimited(spark, str(swapped)).collect()
    ragged = tmp_path / "r.csv"
    ragged.write_text('﻿a,b\n1,"x,y"\n2\n')
    assert S.read_delimited(spark, str(ragged), strict=False).filter("_corrupt is not null").count() == 1
    assert S.read_delimited(spark, str(ragged), strict=False).columns[0] == "a"
    with pytest.raises(Exception, match="does not fit"):
        S.read_delimited(spark, str(ragged)).collect()
    double = tmp_path / "d.csv"
    double.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="names repeat"):
        S.read_delimited(spark, str(double))
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a":1}\n\n[1]\n{"a":1,"a":2}\n')
    bad = S.read_jsonl(spark, str(lines)).filter("problem is not null")
    assert sorted((r["line"], r["problem"]) for r in S.located(bad, spark, str(lines)).collect()) == [(3, "object"), (4, "strict_json")]
    base = spark.createDataFrame([("a",)], "id string")
    path = str(tmp_path / "tokens")
    P.publish_tokens(spark, base, base.withColumn("_tokenized", F.lit("{}")), path, {"v": 1})
    with pytest.raises(ValueError, match="different settings"):
        P.read_tokens(spark, path, {"v": 2})
    with pytest.raises(ValueError, match="lost or repeated"):
        P.publish_tokens(spark, base, base.limit(0), path, {"v": 1})
    assert P.read_tokens(spark, path, {"v": 1}).count() == 1


def test_split_check_names_the_problem(spark):
    rows = spark.createDataFrame([("a", "train", "g"), ("b", "test", "g")], "id string, split string, split_group string")
    rows = rows.withColumn("split_group_inferred", F.lit(False))
    with pytest.raises(ValueError, match="two splits"):
        K.check_splits(rows)
    K.check_splits(rows.filter("id = 'a'"))


def test_manifests_reports_and_temperatures(spark, tmp_path):
    data = str(tmp_path / "data")
    spark.range(20).repartition(2).write.parquet(data)
    files = P.file_digests(spark, data + "/*.parquet")
    rows = files.collect()
    splits = spark.createDataFrame([(r["path"], "train") for r in rows], "path string, split string")
    one = P.split_manifest(files, splits).first()
    assert one["files"] == len(rows) == 2 and one["bytes"] == sum(r["bytes"] for r in rows)
    assert P.split_manifest(files.orderBy(F.col("path").desc()), splits).first() == one
    report = spark.createDataFrame([("choice", 0.7, "m1")], "key string, temperature double, model_sha256 string")
    report.write.parquet(str(tmp_path / "t"))
    assert P.read_temperatures(spark, str(tmp_path / "t"), "m1").first()["value"] == 0.7
    with pytest.raises(Exception, match="different model"):
        P.read_temperatures(spark, str(tmp_path / "t"), "m2").collect()
    S.append_report(report, str(tmp_path / "r"))
    S.append_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    with pytest.raises(Exception, match="non-finite"):
        S.finite_report(report.withColumn("temperature", F.lit(float("nan")))).collect()
    with pytest.raises(ValueError, match="empty dataset"):
        S.require_rows(report.limit(0), "none")


def test_tables_are_spread_by_rows(spark, monkeypatch):
    """A small file of many rows becomes as many tasks as its rows need, whatever its splits."""
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 10, raising=False)
    for name in ("events", "part"):
        rows = fixtures.table(spark, "/root/testdata/sf0.001", name)
        n = rows.count()
        assert rows.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 10)) > spark.sparkContext.defaultParallelism


def test_distinct_questions_are_worked_on_once(spark):
    """``per_distinct`` hands each distinct question to the work once and gives its result to every row."""
    rows = spark.range(90).selectExpr("id", "named_struct('k', id % 3) as question", "string(id % 3) as text")
    out = T.per_distinct(rows, lambda d: d.select("question_sha", "n", "question", F.col("n").alias("rows"), F.col("question.k").alias("k")), "text", F.col("id"), rows_per_task=10)
    assert {(r.id, r.k, r.rows) for r in out.collect()} == {(i, i % 3, 30) for i in range(90)}
