"""Versions, canonical tables, packed texts, protected spans, wide ranks and reused states."""

import json
import random
import threading
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.operators import protect, records, representation
from assayer.plans import plan_queries
from assayer.sources import canonical, packed, versions

GOOD = {
    "schema_version": "v1", "id": "r:1", "task_id": "t", "weight": 1.0,
    "request": {"state": {"b": 1.0, "a": "é"}, "questions": {"q": {"type": "noul"}}, "images": ["data:image/png;base64,iVBORw0KGgo="]},
    "targets": {"q": {"kind": "bernoulli", "p_true": 1}}, "metadata": {"split_group": "g"},
    "views": [{"view_id": "v", "request": {"state": "s", "questions": {"q": {"type": "noul"}}, "images": ["data:image/png;base64,iVBORw0KGgoA"]}}],
}


def test_one_writer_wins(spark, tmp_path):
    path, won = str(tmp_path / "log"), []
    threads = [threading.Thread(target=lambda k=k: won.append((k, versions.put_if_absent(spark, f"{path}/_versions/0.json", str(k))))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [k for k, ok in won if ok]
    assert len(winner) == 1 and (tmp_path / "log/_versions/0.json").read_text() == str(winner[0])


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.latest(spark, path) is None and versions.snapshots(spark, path).count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    tokens = rows.select("id", F.lit("{}").alias("_tokenized"), F.array("x").alias("_token_costs"))
    assert packed.publish_tokens(spark, rows, tokens, path, {"v": 1}, after=None) == 0
    with pytest.raises(versions.Conflict):
        packed.publish_tokens(spark, rows, tokens, path, {"v": 1}, after=None)
    assert packed.publish_tokens(spark, rows, tokens, path, {"v": 1}) == 1
    last = versions.latest(spark, path)
    assert (last["version"], last["parent"]) == (1, 0) and json.loads(last["state"])["tokens"] == 3
    assert packed.read_tokens(spark, path, {"v": 1}, check=True).count() == 2
    rows.limit(1).join(tokens, "id").write.mode("overwrite").parquet(last["data"])
    with pytest.raises(ValueError, match="not those"):
        packed.read_tokens(spark, path, {"v": 1}, check=True)
    with pytest.raises(ValueError, match="no version"):
        packed.read_tokens(spark, str(tmp_path / "none"), {"v": 1})


def test_canonical(spark, tmp_path):
    texts = [json.dumps(GOOD), json.dumps({**GOOD, "id": "r:2"}), json.dumps(GOOD, indent=1)]
    rows = records.parse_records(spark.createDataFrame([(t,) for t in texts], "value string"))
    path = str(tmp_path / "c")
    canonical.write_canonical(rows, path)
    slim = canonical.planned(spark, path)
    assert slim.select("fingerprint").distinct().count() == 2
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "record_json" not in plan
    assert canonical.footer_facts(spark, path, ["id"]) == {"rows": 3, "id_values": 3}
    with pytest.raises(ValueError, match="empty"):
        canonical.write_canonical(rows.limit(0), str(tmp_path / "e"))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no canonical"):
        canonical.read_canonical(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no packed"):
        packed.read_packed(spark, path)


def test_pack_keeps_the_text(spark):
    """Weight 1.0, key order and number spellings survive; only images are taken out, each once."""
    text = json.dumps(GOOD, ensure_ascii=False)
    rows = records.parse_records(spark.createDataFrame([(text,)], "value string"))
    found = packed.pack(rows).first()
    stored = json.loads(found.record_json)
    assert [len(i.bytes) for i in found.images] == [8, 9] and "base64" not in found.record_json
    assert stored["weight"] == 1.0 and '"weight":1.0' in found.record_json and list(stored) == list(GOOD)
    assert stored["request"]["images"] == [{"image_index": 0, "mime_type": "image/png"}] and stored["views"][0]["request"]["images"][0]["image_index"] == 1
    back = packed.unpack(packed.packed_problem(packed.pack(rows).drop("problem"))).first()
    assert back.problem is None and json.loads(back.value) == GOOD


def test_views_that_are_no_list(spark):
    from assayer.operators.validate import audit_views

    rows = records.parse_records(spark.createDataFrame([(json.dumps({**GOOD, "views": v}),) for v in ("oops", None, [])], "value string"))
    got = [(len(r.accepted_views or []), [x.reasons for x in r.rejected_views or []]) for r in audit_views(rows).collect()]
    assert got == [(0, [["views_list"]]), (0, [["views_list"]]), (0, [])]


def test_animation_chunks():
    def chunk(name, data=b""):
        return len(data).to_bytes(4, "big") + name + data + b"0000"

    head = b"\x89PNG\r\n\x1a\n"
    assert packed._animated("image/png", head + chunk(b"IHDR", b"x" * 13) + chunk(b"acTL", b"12345678") + chunk(b"IDAT"))
    assert not packed._animated("image/png", head + chunk(b"tEXt", b"acTL") + chunk(b"IDAT", b"acTL") + chunk(b"acTL"))
    assert not packed._animated("image/png", head) and not packed._animated("image/png", b"")
    webp = b"RIFF0000WEBP"
    piece = lambda name, data: name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    assert packed._animated("image/webp", webp + piece(b"VP8X", b"123") + piece(b"ANIM", b"123456"))
    assert not packed._animated("image/webp", webp + piece(b"VP8 ", b"ANIM8"))


def test_protected_spans(spark):
    spellings = {"<a>": 5, "<a><b>": 6, "<b>": 7, "é": 8}
    rng = random.Random(3)
    texts = ["".join(rng.choice(["<a>", "<b>", "<", "a", "é", "😀", " "]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "id long, t string")
    got = {r.id: [tuple(x) for x in r.s] for r in rows.select("id", protect.protected_spans(F.col("t"), spellings).alias("s")).collect()}
    want = {i: sorted((k, k + len(s), n) for s, n in spellings.items() for k in range(len(t)) if t.startswith(s, k)) for i, t in enumerate(texts)}
    assert got == {**want, 900: [], 901: []}


def test_neutralized(spark):
    kind = "t string, k array<struct<id:int,start:int,stop:int>>"
    rows = spark.createDataFrame([("x<a><b>é", [(900, 0, 1), (6, 1, 7), (8, 7, 8)]), ("<a>", [(901, 0, 3)]), ("", []), (None, None), ("<b><a>", [(7, 0, 3), (902, 3, 6)])], kind)
    spellings = {"<a>": 5, "<a><b>": 6, "<b>": 7, "é": 8}
    got = [r.i for r in rows.select(protect.neutralized(F.col("k"), F.col("t"), spellings, byte_base=100).alias("i")).collect()]
    ids = lambda s: [100 + b for b in s.encode()]
    assert got == [[900, *ids("<a><b>é")], [901], [], None, [*ids("<b>"), 902]]
    for text, token in (("xyz", (6, 0, 3)), ("<a><b>", (5, 0, 6)), ("<a>", (9, 0, 3))):
        bad = spark.createDataFrame([(text, [token])], kind)
        with pytest.raises(Exception, match="literal source span"):
            bad.select(protect.neutralized(F.col("k"), F.col("t"), spellings, protected=frozenset([9]), byte_base=100)).collect()
    with pytest.raises(ValueError):
        protect.neutralized(F.col("k"), F.col("t"), spellings)


def test_wide_rank(spark):
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 90)) + 0.3
    rows = spark.createDataFrame([(x.tolist(),) for x in flat] + [(None,), ([],)], "vector array<double>")
    unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
    energy = np.clip(np.linalg.eigvalsh(np.cov(unit.T, bias=True))[::-1], 0, None)
    p = energy / energy.sum()
    exact = float(np.exp(-(p[p > 1e-15] * np.log(p[p > 1e-15])).sum()))
    got = representation.wide_rank(rows, width=12, rounds=12)
    assert got["count"] == 300 and np.allclose(got["energies"][:7], energy[:7], rtol=1e-6)
    assert abs(got["effective_rank_low"] - exact) < 1e-4 and abs(got["effective_rank_high"] - exact) < 1e-4
    full = representation.representation_stats(rows).first()
    assert abs(full.effective_rank - exact) < 1e-6
    few = representation.wide_rank(rows, width=3, rounds=10)
    assert few["effective_rank_low"] < exact < few["effective_rank_high"]
    assert representation.wide_rank(rows.limit(0))["count"] == 0


def test_tokens_of_a_large_batch_stay_small(monkeypatch):
    """Tokenizing, searching and replacing a batch take no Python object per token."""
    taken = []
    monkeypatch.setattr(protect.F, "arrow_udf", lambda run, kind: lambda *columns: taken.append(run))
    monkeypatch.setattr(protect, "package_path", lambda spark: None)
    monkeypatch.setattr(protect, "PORTION", 1000, raising=False)
    plan_queries._outside_tokens(None), protect.protected_spans(None, plan_queries.GUARDED), protect.neutralized(None, None, plan_queries.GUARDED)
    texts = pa.array(["a b " * 5000 + "<unused0>"] * 10 + [None, ""])
    tracemalloc.start()
    tokens = taken[0](texts)
    spans, ids = taken[1](texts), taken[2](tokens, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in ids[:10]] == [10_009] * 10 and [len(x) for x in ids[10:]] == [0, 0]
    assert spans[0].as_py() == [{"start": 20_000, "stop": 20_009, "id": 50_000}]
    assert peak < 100 * 100_000


def test_a_packed_record_is_read_once_per_step(spark):
    """identity, references and restored texts took the members of the record's text anew each time."""
    rows = spark.createDataFrame([("a", "s", "1", "{}", [])], f"id string, dataset string, schema_version string, record_json string, images {packed.IMAGE}")
    for step in (packed.packed_problem, packed.unpack):
        plan = step(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(MapType(StringType,VariantType,true), record_json") == 1, plan
        assert step(rows).columns == [*rows.columns, *(["refs", "problem"] if step is packed.packed_problem else ["value"])]
