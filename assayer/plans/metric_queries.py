"""Scoring rules, summaries, calibration error and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.scoring import score
from assayer.operators import metrics as M
from assayer.plans import fixtures as X
from assayer.plans.sql import CHOICE10, ECE, SOFT10, fold, r6, softmax


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _choice_scored(spark, folder):
    return score(M.with_target_vectors(X.choice10(spark, folder)), 10)


def metric_summary_choice(spark, folder):
    out = M.summarize(_choice_scored(spark, folder))
    return _rounded(
        out.select("nll", "accuracy", "brier", "distribution_brier", "top_probability", "ece",
                   "questions", "effective_weight"),
        "nll", "accuracy", "brier", "distribution_brier", "top_probability", "ece",
    )


def metric_ece_bins(spark, folder):
    return _rounded(
        M.reliability_bins(_choice_scored(spark, folder)), "probability", "correctness"
    )


def ece_by_label(spark, folder):
    out = M.summarize(_choice_scored(spark, folder), ["label"])
    return _rounded(out.select("label", "ece", "accuracy", "nll", "questions"),
                    "ece", "accuracy", "nll")


def metric_soft_choice(spark, folder):
    out = M.summarize(score(M.with_target_vectors(X.soft10(spark, folder)), 10))
    return _rounded(out.select("nll", "accuracy", "brier", "distribution_brier", "ece"),
                    "nll", "accuracy", "brier", "distribution_brier", "ece")


def metric_allowed_set(spark, folder):
    out = M.summarize(score(M.with_target_vectors(X.allowed10(spark, folder)), 10))
    return _rounded(out.select("nll", "allowed_accuracy", "questions"), "nll", "allowed_accuracy")


def _noul(spark, folder, soft):
    rows = M.effective_weights(X.noul2(spark, folder, soft=soft))
    return score(M.with_target_vectors(rows), 2)


def metric_noul(spark, folder):
    out = M.summarize(_noul(spark, folder, False), ["qid"])
    return _rounded(
        out.select("qid", "nll", "accuracy", "brier", "ece", "questions", "effective_weight"),
        "nll", "accuracy", "brier", "ece", "effective_weight",
    )


def metric_noul_soft(spark, folder):
    out = M.summarize(_noul(spark, folder, True))
    return _rounded(out.select("nll", "accuracy", "distribution_brier", "effective_weight"),
                    "nll", "accuracy", "distribution_brier", "effective_weight")


def effective_weights(spark, folder):
    rows = M.effective_weights(X.noul2(spark, folder))
    return _rounded(rows.select("id", "qid", "weight"), "weight")


def metric_score_rps(spark, folder):
    out = M.summarize(score(M.with_target_vectors(X.score5(spark, folder)), 5))
    return _rounded(out.select("nll", "accuracy", "rps", "distribution_rps", "ece", "questions"),
                    "nll", "accuracy", "rps", "distribution_rps", "ece")


def metric_score_scale(spark, folder):
    out = M.summarize(score(M.with_target_vectors(X.score10(spark, folder)), 10), ["l_returnflag"])
    return _rounded(out.select("l_returnflag", "nll", "accuracy", "brier", "rps", "questions"),
                    "nll", "accuracy", "brier", "rps")


def nonfinite_logits(spark, folder):
    """Logits with NaN and infinities are cleaned and counted."""
    rows = X.choice10(spark, folder)
    bad = (
        F.when(F.pmod("id", F.lit(13)) == 1, F.lit(float("nan")))
        .when(F.pmod("id", F.lit(13)) == 2, F.lit(float("inf")))
        .when(F.pmod("id", F.lit(13)) == 3, F.lit(float("-inf")))
    )
    rows = rows.withColumn(
        "logits", F.transform("logits", lambda z, i: F.coalesce(F.when(i == 3, bad), z))
    )
    out = M.summarize(score(M.with_target_vectors(rows), 10))
    return _rounded(out.select("nll", "accuracy", "non_finite_logits"), "nll", "accuracy")


def risk_coverage(spark, folder):
    rows = score(M.with_target_vectors(X.event_choice(spark, folder)), 5)
    rows = rows.withColumn("top_probability", F.round("top_probability", 9))
    return _rounded(M.risk_coverage(rows), "threshold", "coverage", "risk")


def _sliced(spark, folder):
    rows = _noul(spark, folder, True)
    return rows.withColumn(
        "labels",
        M.slice_labels(
            F.col("type"), F.col("source"), F.col("n_chars"), F.lit(9), F.col("n_chars") % 700,
            F.size("keys"), F.array("lang"),
        ),
    )


def slice_report(spark, folder):
    out = M.slice_report(_sliced(spark, folder))
    return _rounded(out.select("slice", "nll", "accuracy", "ece", "questions", "effective_weight"),
                    "nll", "accuracy", "ece", "effective_weight")


def slice_curves(spark, folder):
    rows = _sliced(spark, folder).withColumn("top_probability", F.round("top_probability", 9))
    out = M.slice_curves(rows)
    return _rounded(out, "threshold", "coverage", "risk")


def decision_join(spark, folder):
    """Questions, targets and predictions as three tables, matched by record and question."""
    rows = X.noul2(spark, folder)
    questions = rows.select("id", "qid", "type", "keys", "record_weight")
    targets = rows.filter(F.col("qid") == "toxic").select("id", "qid", "kind", "p_true",
                                                         "question_weight")
    predictions = rows.select("id", "qid", "logits")
    joined = M.effective_weights(M.decisions(questions, targets, predictions))
    out = score(M.with_target_vectors(joined), 2)
    return _rounded(out.select("id", "qid", "weight", "nll"), "weight", "nll")


QUERIES = {
    f.__name__: f
    for f in (
        metric_summary_choice, metric_ece_bins, ece_by_label, metric_soft_choice,
        metric_allowed_set, metric_noul, metric_noul_soft, effective_weights, metric_score_rps,
        metric_score_scale, nonfinite_logits, risk_coverage, slice_report, slice_curves,
        decision_join,
    )
}

# One row per vector: the metrics of the class target.
_CHOICE_ROWS = f"""{CHOICE10}, {softmax()},
q AS (SELECT id, label, 1.0 AS weight, any_value(top) AS top,
  sum(CASE WHEN k = label THEN lse - z END) AS nll,
  sum(CASE WHEN k = mode AND k = label THEN 1.0 ELSE 0.0 END) AS accuracy,
  sum(p * p) - 2 * sum(CASE WHEN k = label THEN p END) + 1 AS brier,
  sum((p - CASE WHEN k = label THEN 1 ELSE 0 END) ** 2) AS dbrier
  FROM p0 GROUP BY id, label)"""

_SOFT_ROWS = f"""{CHOICE10}, {softmax()}, {SOFT10},
q AS (SELECT p0.id, 1.0 AS weight, any_value(top) AS top, sum(t * (lse - z)) AS nll,
  sum(CASE WHEN p0.k = mode THEN t END) AS accuracy,
  sum(p * p) - 2 * sum(p * t) + 1 AS brier, sum((p - t) ** 2) AS dbrier
  FROM p0 JOIN t0 ON p0.id = t0.id AND p0.k = t0.k GROUP BY p0.id)"""


def _noul_rows(soft: bool) -> str:
    p = "y * 0.8 + 0.1" if soft else "1.0 * y"
    return f"""b AS (
  SELECT d.doc_id AS id, u.qid, d.n_chars, d.lang, d.source, 1.0 + d.doc_id % 3 AS rw,
    CASE WHEN u.qid = 'quality' THEN 2.0 ELSE 1.0 END AS qw,
    CASE WHEN u.qid = 'quality' THEN l.quality ELSE l.toxic END AS y,
    CASE WHEN u.qid = 'quality' THEN 1 ELSE -1 END * (d.n_chars % 17 - 8) / 4.0 AS x
  FROM documents d JOIN labels l USING (doc_id)
  CROSS JOIN (VALUES ('quality'), ('toxic')) u(qid)),
c AS (SELECT *, {p} AS pt, 1 / (1 + exp(-x)) AS p, rw * qw / 3.0 AS weight FROM b),
q AS (SELECT *, -(pt * ln(p) + (1 - pt) * ln(1 - p)) AS nll, greatest(p, 1 - p) AS top,
  CASE WHEN x >= 0 THEN pt ELSE 1 - pt END AS accuracy,
  p * p + (1 - p) * (1 - p) - 2 * (p * pt + (1 - p) * (1 - pt)) + 1 AS brier,
  2 * (p - pt) ** 2 AS dbrier FROM c)"""


_SCORE5 = f"""b AS (SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS level, k,
  (o_totalprice / 100000.0 - o_orderkey % 5) * (k - 2) / 2.0 - (o_orderkey + k) % 3 AS z
  FROM orders CROSS JOIN range(0, 5) r(k)), {softmax('b')},
c AS (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY k) AS fp,
  CASE WHEN k >= level THEN 1.0 ELSE 0.0 END AS ft FROM p0),
q AS (SELECT id, 1.0 AS weight, any_value(top) AS top,
  sum(CASE WHEN k = level THEN lse - z END) AS nll,
  sum(CASE WHEN k = mode AND k = level THEN 1.0 ELSE 0.0 END) AS accuracy,
  sum(CASE WHEN k < 4 THEN fp * fp - 2 * fp * ft + ft END) / 4 AS rps,
  sum(CASE WHEN k < 4 THEN (fp - ft) ** 2 END) / 4 AS drps
  FROM c GROUP BY id)"""

_CURVE = """g AS (SELECT round(top, 9) AS threshold, sum(weight) AS w,
  sum(weight * (1 - accuracy)) AS e{by} FROM {src} GROUP BY round(top, 9){by}),
n AS (SELECT *, sum(w) OVER (PARTITION BY {key} ORDER BY threshold DESC) AS cw,
  sum(e) OVER (PARTITION BY {key} ORDER BY threshold DESC) AS ce,
  sum(w) OVER (PARTITION BY {key}) AS total,
  row_number() OVER (PARTITION BY {key} ORDER BY threshold DESC) - 1 AS pos,
  count(*) OVER (PARTITION BY {key}) AS cnt FROM g)"""
_PICK = """pos IN (SELECT CAST(round_even((cnt - 1) * i / 10.0, 0) AS BIGINT) FROM range(0, 11) r(i))"""

_LABELS = """s AS (SELECT q.*, u.slice FROM q CROSS JOIN LATERAL (
  SELECT unnest(['overall', 'primitive:noul', 'source:' || source, 'I:128', 'K:2', 'slice:' || lang,
    'S:' || CASE WHEN n_chars <= 128 THEN '128' WHEN n_chars <= 256 THEN '256' WHEN n_chars <= 512 THEN '512'
      WHEN n_chars <= 1024 THEN '1024' WHEN n_chars <= 2048 THEN '2048' WHEN n_chars <= 4096 THEN '4096'
      WHEN n_chars <= 32768 THEN '32768' ELSE '>32768' END,
    'T:' || CASE WHEN n_chars % 700 <= 128 THEN '128' WHEN n_chars % 700 <= 256 THEN '256'
      WHEN n_chars % 700 <= 512 THEN '512' ELSE '1024' END]) AS slice) u)"""

_NONFINITE = CHOICE10.replace(
    f"4 * ({fold()})",
    "CASE WHEN k = 3 AND vec_id % 13 = 1 THEN -1e6 WHEN k = 3 AND vec_id % 13 = 2 THEN 1e6 "
    f"WHEN k = 3 AND vec_id % 13 = 3 THEN -1e6 ELSE 4 * ({fold()}) END",
)

ORACLE = {
    "metric_summary_choice": f"""WITH {_CHOICE_ROWS}
SELECT {r6('avg(nll)')} AS nll, {r6('avg(accuracy)')} AS accuracy, {r6('avg(brier)')} AS brier,
  {r6('avg(dbrier)')} AS distribution_brier, {r6('avg(top)')} AS top_probability,
  {r6(ECE)} AS ece, count(*) AS questions, CAST(sum(weight) AS DOUBLE) AS effective_weight FROM q""",
    "metric_ece_bins": f"""WITH {_CHOICE_ROWS}
SELECT least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, CAST(sum(weight) AS DOUBLE) AS weight,
  {r6('avg(top)')} AS probability, {r6('avg(accuracy)')} AS correctness FROM q GROUP BY 1""",
    "ece_by_label": f"""WITH {_CHOICE_ROWS},
b AS (SELECT label, least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, count(*) AS n,
  sum(top) AS a, sum(accuracy) AS c, sum(nll) AS s FROM q GROUP BY 1, 2)
SELECT label, {r6('sum(abs(a - c)) / sum(n)')} AS ece, {r6('sum(c) / sum(n)')} AS accuracy,
  {r6('sum(s) / sum(n)')} AS nll, CAST(sum(n) AS BIGINT) AS questions FROM b GROUP BY label""",
    "metric_soft_choice": f"""WITH {_SOFT_ROWS}
SELECT {r6('avg(nll)')} AS nll, {r6('avg(accuracy)')} AS accuracy, {r6('avg(brier)')} AS brier,
  {r6('avg(dbrier)')} AS distribution_brier, {r6(ECE)} AS ece FROM q""",
    "metric_allowed_set": f"""WITH {CHOICE10}, {softmax()},
q AS (SELECT id, -ln(sum(CASE WHEN k = label OR k = (label + 1) % 10 THEN p END)) AS nll,
  max(CASE WHEN k = mode AND (k = label OR k = (label + 1) % 10) THEN 1.0 ELSE 0.0 END) AS ok
  FROM p0 GROUP BY id)
SELECT {r6('avg(nll)')} AS nll, {r6('avg(ok)')} AS allowed_accuracy, count(*) AS questions FROM q""",
    "metric_noul": f"""WITH {_noul_rows(False)},
b2 AS (SELECT qid, least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, sum(weight) AS w,
  sum(weight * top) AS a, sum(weight * accuracy) AS c, sum(weight * nll) AS s, sum(weight * brier) AS br,
  count(*) AS n FROM q GROUP BY 1, 2)
SELECT qid, {r6('sum(s) / sum(w)')} AS nll, {r6('sum(c) / sum(w)')} AS accuracy,
  {r6('sum(br) / sum(w)')} AS brier, {r6('sum(abs(a - c)) / sum(w)')} AS ece,
  CAST(sum(n) AS BIGINT) AS questions, {r6('sum(w)')} AS effective_weight FROM b2 GROUP BY qid""",
    "metric_noul_soft": f"""WITH {_noul_rows(True)}
SELECT {r6('sum(weight * nll) / sum(weight)')} AS nll, {r6('sum(weight * accuracy) / sum(weight)')} AS accuracy,
  {r6('sum(weight * dbrier) / sum(weight)')} AS distribution_brier,
  {r6('sum(weight)')} AS effective_weight FROM q""",
    "effective_weights": f"""WITH {_noul_rows(False)} SELECT id, qid, {r6('weight')} AS weight FROM q""",
    "metric_score_rps": f"""WITH {_SCORE5}
SELECT {r6('avg(nll)')} AS nll, {r6('avg(accuracy)')} AS accuracy, {r6('avg(rps)')} AS rps,
  {r6('avg(drps)')} AS distribution_rps, {r6(ECE)} AS ece, count(*) AS questions FROM q""",
    "metric_score_scale": f"""WITH l AS (SELECT row_number() OVER () AS id, l_returnflag, l_quantity,
  least(9, CAST(round(l_discount * 100) AS INTEGER)) AS level FROM lineitem),
b AS (SELECT id, l_returnflag, level, k, sin(l_quantity * (k + 1)) - abs(level - k) * 0.25 AS z
  FROM l CROSS JOIN range(0, 10) r(k)), {softmax('b')},
c AS (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY k) AS fp,
  CASE WHEN k >= level THEN 1.0 ELSE 0.0 END AS ft FROM p0),
q AS (SELECT id, l_returnflag, sum(CASE WHEN k = level THEN lse - z END) AS nll,
  sum(CASE WHEN k = mode AND k = level THEN 1.0 ELSE 0.0 END) AS accuracy,
  sum(p * p) - 2 * sum(CASE WHEN k = level THEN p END) + 1 AS brier,
  sum(CASE WHEN k < 9 THEN fp * fp - 2 * fp * ft + ft END) / 9 AS rps FROM c GROUP BY 1, 2)
SELECT l_returnflag, {r6('avg(nll)')} AS nll, {r6('avg(accuracy)')} AS accuracy, {r6('avg(brier)')} AS brier,
  {r6('avg(rps)')} AS rps, count(*) AS questions FROM q GROUP BY 1""",
    "nonfinite_logits": f"""WITH {_NONFINITE}, {softmax()},
q AS (SELECT id, sum(CASE WHEN k = label THEN lse - z END) AS nll,
  sum(CASE WHEN k = mode AND k = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM p0 GROUP BY id)
SELECT {r6('avg(nll)')} AS nll, {r6('avg(accuracy)')} AS accuracy,
  CAST(sum(CASE WHEN id % 13 IN (1, 2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS non_finite_logits FROM q""",
    "risk_coverage": f"""WITH ev AS (SELECT event_id AS id, 1.0 + event_id % 2 AS weight,
  least(0.99, 0.25 + value / 700.0) AS hi, user_id % 5 AS m,
  list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS truth FROM events),
b AS (SELECT id, weight, truth, k, ln(CASE WHEN m = k THEN hi ELSE (1 - hi) / 4 END) AS z
  FROM ev CROSS JOIN range(0, 5) r(k)), {softmax('b')},
q AS (SELECT id, any_value(weight) AS weight, any_value(top) AS top,
  max(CASE WHEN k = mode AND k = truth THEN 1.0 ELSE 0.0 END) AS accuracy FROM p0 GROUP BY id),
{_CURVE.format(by='', src='q', key='1')}
SELECT {r6('threshold')} AS threshold, {r6('cw / total')} AS coverage, {r6('ce / cw')} AS risk FROM n WHERE {_PICK}""",
    "slice_report": f"""WITH {_noul_rows(True)}, {_LABELS},
b2 AS (SELECT slice, least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, sum(weight) AS w,
  sum(weight * top) AS a, sum(weight * accuracy) AS c, sum(weight * nll) AS m, count(*) AS n
  FROM s GROUP BY 1, 2)
SELECT slice, {r6('sum(m) / sum(w)')} AS nll, {r6('sum(c) / sum(w)')} AS accuracy,
  {r6('sum(abs(a - c)) / sum(w)')} AS ece, CAST(sum(n) AS BIGINT) AS questions,
  {r6('sum(w)')} AS effective_weight FROM b2 GROUP BY slice""",
    "slice_curves": f"""WITH {_noul_rows(True)}, {_LABELS}, {_CURVE.format(by=', slice', src='s', key='slice')}
SELECT slice, {r6('threshold')} AS threshold, {r6('cw / total')} AS coverage, {r6('ce / cw')} AS risk
FROM n WHERE {_PICK}""",
    "decision_join": f"""WITH {_noul_rows(False)}
SELECT id, qid, rw AS weight, {r6('nll')} AS nll FROM q WHERE qid = 'toxic'""",
}
