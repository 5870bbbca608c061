"""Scoring formulas against NumPy, and both vector forms against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions.scoring import METRICS, probabilities, score, score_arrays
from assayer.operators import losses
from assayer.operators.answers import answers, rotation_average, rotation_variants, temperature_violations
from assayer.operators.calibration import fit_temperatures
from assayer.operators.metrics import risk_coverage, summarize, with_target_vectors
from assayer.operators.representation import representation_stats
from assayer.operators.skew import fan_out_join

SCHEMA = (
    "id long, type string, kind string, keys array<string>, logits array<double>, p_true double, "
    "value string, dist array<double>, allowed_keys array<string>, weight double"
)


def mixed_rows(n=300, seed=3, most=20):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = ("bernoulli", "class", "distribution", "allowed_set")[i % 4]
        k = 2 if kind == "bernoulli" else int(rng.integers(1, most))
        qtype = "noul" if kind == "bernoulli" else ("score" if 2 <= k <= 10 and i % 3 == 0 else "choice")
        keys = ["true", "false"] if kind == "bernoulli" else [str(j) for j in range(k)]
        z = rng.normal(size=k) * 3
        if i % 29 == 0:
            z[0] = (math.nan, math.inf, -math.inf)[i % 3]
        dist = rng.dirichlet(np.ones(k))
        rows.append(
            (
                i, qtype, kind, keys, z.tolist(), float(rng.random()) if kind == "bernoulli" else None,
                keys[int(rng.integers(k))] if kind == "class" else None,
                dist.tolist() if kind == "distribution" else None,
                keys[: max(1, k // 2)] if kind == "allowed_set" else None, float(rng.random() + 0.1),
            )
        )
    return rows


def expected(row):
    _i, qtype, kind, keys, z, p_true, value, dist, allowed, _w = row
    z = np.nan_to_num(np.array(z), nan=-1e6, posinf=1e6, neginf=-1e6)
    e = np.exp(z - z.max())
    p = e / e.sum()
    lp = z - z.max() - math.log(e.sum())
    c = int(p.argmax())
    if kind == "allowed_set":
        on = [keys.index(a) for a in allowed]
        top = lp[on].max()
        return {"nll": -(top + math.log(np.exp(lp[on] - top).sum())), "allowed_accuracy": float(keys[c] in allowed)}
    if kind == "bernoulli":
        t = np.array([p_true, 1 - p_true])
        x = z[0] - z[1]
        nll = max(x, 0) - x * p_true + math.log1p(math.exp(-abs(x)))
    else:
        t = np.array(dist) if kind == "distribution" else np.array([float(k == value) for k in keys])
        nll = -(t * lp).sum()
    out = {
        "nll": nll, "accuracy": t[c], "brier": (p * p).sum() - 2 * (p * t).sum() + 1,
        "distribution_brier": ((p - t) ** 2).sum(), "top_probability": p[c],
    }
    if qtype == "score":
        fp, ft = p.cumsum()[:-1], t.cumsum()[:-1]
        out["rps"] = (fp * fp - 2 * fp * ft + ft).mean()
        out["distribution_rps"] = ((fp - ft) ** 2).mean()
    return out


def test_both_forms_match_numpy(spark):
    rows = mixed_rows()
    df = with_target_vectors(spark.createDataFrame(rows, SCHEMA))
    for form in (score, score_arrays):
        got = {r["id"]: r for r in form(df).collect()}
        assert len(got) == len(rows)
        for row in rows:
            want = expected(row)
            for m in METRICS:
                value = got[row[0]][m]
                if m in want:
                    assert value == pytest.approx(want[m], rel=1e-9, abs=1e-9), (row[0], m)
                else:
                    assert value is None
            assert got[row[0]]["non_finite"] == int(not np.isfinite(row[4]).all())


def test_width_is_checked(spark):
    df = with_target_vectors(spark.createDataFrame(mixed_rows(40), SCHEMA))
    with pytest.raises(Exception, match="more than 3 outcomes"):
        score(df, 3).collect()


@pytest.mark.parametrize("t", [1e-300, 1e-3, 1.0, 1e3, 1e300])
def test_softmax_is_stable(spark, t):
    df = spark.createDataFrame([([1e308, -1e308, 0.0],), ([1.0, 2.0, 2.0],)], "z array<double>")
    for r in df.select(probabilities(F.col("z"), t).alias("p")).collect():
        assert sum(r["p"]) == pytest.approx(1) and all(0 <= x <= 1 for x in r["p"])


def test_summary_bounds_and_curve(spark):
    rows = score(with_target_vectors(spark.createDataFrame(mixed_rows(500), SCHEMA))).cache()
    s = summarize(rows).first()
    assert 0 <= s["ece"] <= 1 and s["questions"] == 500 and s["brier"] >= 0
    for buckets in (1, 3, 40):
        curve = sorted((tuple(r) for r in risk_coverage(rows, buckets=buckets).collect()), reverse=True)
        assert len(curve) == 11 and curve[-1][1] == pytest.approx(1.0)
        if buckets == 1:
            first = curve
        assert np.allclose(curve, first)


def test_answers_and_rotations(spark):
    df = spark.createDataFrame(
        [(1, "q", "choice", ["a", "b", "c"], [0.0, 1.0, 1.0]), (2, "q", "choice", ["only"], [3.0]),
         (3, "q", "score", ["0", "1", "2"], [0.0, 0.0, 0.0])],
        "id long, qid string, type string, keys array<string>, logits array<double>",
    )
    got = {r["id"]: r for r in answers(df).collect()}
    assert got[1]["choice"] == "b" and got[2]["confidence"] == 1.0 and got[3]["score"] == pytest.approx(1.0)
    turned = rotation_variants(df).withColumn(
        "p", F.transform("keys", lambda k, i: 1.0 / F.size("keys") + (F.size("keys") - 1 - 2 * i) * 0.01))
    mean = {r["id"]: r for r in rotation_average(turned).collect()}
    assert mean[1]["keys"] == ["a", "b", "c"] and mean[1]["p"] == pytest.approx([1 / 3] * 3)
    bad = spark.createDataFrame(
        [("choice", 1.0), ("choice:", 1.0), ("choice:1", 1.0), ("noul:2", 0.0), ("x", 1.0), ("score:4", math.inf)],
        "key string, value double")
    assert {r["key"] for r in temperature_violations(bad).collect()} == {"choice:1", "noul:2", "x", "score:4"}


def test_temperature_fit_recovers_scale(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        z = rng.normal(size=4)
        p = np.exp(z) / np.exp(z).sum()
        rows.append((i, "choice", "class", list("abcd"), (z * 2.5).tolist(), None, "abcd"[rng.choice(4, p=p)], None, None, 1.0))
    df = with_target_vectors(spark.createDataFrame(rows, SCHEMA))
    a, b = fit_temperatures(df, width=4).first(), fit_temperatures(df).first()
    assert a["temperature"] == pytest.approx(2.5, rel=0.1) and a["nll_after"] < a["nll_before"]
    assert a["temperature"] == pytest.approx(b["temperature"], rel=1e-6)


def test_representation_matches_svd(spark):
    x = np.random.default_rng(1).normal(size=(200, 7)) * np.arange(1, 8)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "vector array<double>").repartition(5)
    got = representation_stats(df).first()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    e = np.linalg.svd(unit - unit.mean(0), compute_uv=False) ** 2
    q = e / e.sum()
    assert got["effective_rank"] == pytest.approx(math.exp(-(q * np.log(q)).sum()))
    assert got["direction_variance"] == pytest.approx(unit.var(0).mean())
    assert got["mean_norm"] == pytest.approx(np.linalg.norm(x, axis=1).mean())


def test_fan_out_join_splits_a_hot_key(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = fan_out_join(facts, dim.withColumn("v", F.length("k")), "k", F.col("id"), rows_per_task=100)
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    assert out.filter("k = 'hot'").select("v").distinct().collect()[0]["v"] == 3


def test_alignment_needs_every_readout(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    with pytest.raises(Exception, match="one row per outcome"):
        df.select(losses.readout_alignment(F.col("a"), F.col("b"))).collect()


def test_representation_of_odd_vectors(spark):
    df = spark.createDataFrame([([3.0],), (None,), ([],), ([-1.0],)], "vector array<double>")
    got = representation_stats(df).first()
    assert got["count"] == 2 and got["mean_norm"] == 2.0 and got["effective_rank"] == pytest.approx(1.0)


@pytest.mark.parametrize("width", [None, 4])
def test_lost_or_uneven_logits_fail(spark, width):
    from assayer.functions.scoring import score

    schema = "type string, kind string, keys array<string>, logits array<double>, t array<double>, allowed array<double>"
    good = ("choice", "class", ["a", "b"], [0.1, 0.2], [1.0, 0.0], None)
    assert score(spark.createDataFrame([good], schema), width).count() == 1
    for bad in ((*good[:3], None, *good[4:]), (*good[:3], [], *good[4:]), (*good[:3], [0.1, 0.2, 0.3], *good[4:])):
        with pytest.raises(Exception, match="logits"):
            score(spark.createDataFrame([good, bad], schema), width).collect()


def test_repeated_temperature_fails(spark):
    from assayer.operators.answers import with_temperature

    rows = spark.createDataFrame([("choice", ["a", "b"])], "type string, keys array<string>")
    twice = spark.createDataFrame([("choice", 2.0), ("choice", 3.0)], "key string, value double")
    assert with_temperature(rows, twice.limit(1)).first()["temperature"] == 2.0
    with pytest.raises(Exception, match="repeats"):
        with_temperature(rows, twice).collect()


def test_long_chain_and_deep_log(spark):
    from assayer.operators.leakage import ancestors
    from assayer.operators.runs import scalar_metrics

    runs = spark.range(1500).selectExpr("cast(id as string) run", "if(id > 0, cast(id - 1 as string), null) parent", "false self_contained")
    closure = ancestors(runs).filter("run = '1499'")
    assert closure.count() == 1500 and closure.selectExpr("max(depth)").first()[0] == 1499
    text = '{"a":' * 12 + '{"x":1.5,"s":"}{"}' + "}" * 12
    got = scalar_metrics(spark.createDataFrame([(1, text)], "id long, line string"), "line", ["id"]).collect()
    assert [(r["name"].count("/"), r["value"]) for r in got] == [(12, 1.5)]


def test_view_set_with_repeated_id_fails(spark):
    from assayer.operators.leakage import attach_views

    kind = "id string, views array<string>"
    records = spark.createDataFrame([("a", None)], kind)
    with pytest.raises(Exception, match="repeats an id"):
        attach_views(records, spark.createDataFrame([("a", ["v"]), ("a", ["w"])], kind)).collect()
    assert attach_views(records, spark.createDataFrame([("a", ["v"])], kind)).first()["views"] == ["v"]


def test_states_are_encoded_once(spark):
    from pyspark.sql import functions as F

    from assayer.operators.answers import shared_states

    rows = spark.range(100).selectExpr("id", "concat('s', id % 7) state")
    encode = lambda df: df.mapInPandas(lambda it: (x.assign(size=x.state.str.len()) for x in it), "state_sha string, state string, n long, size long")
    out = shared_states(rows, "state", encode, row_key=F.col("id"), rows_per_task=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and out.count() == 100
