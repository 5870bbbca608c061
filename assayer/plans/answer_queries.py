"""Answers, benchmark metrics, losses and temperature fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.constants import BOOLEAN, CHOICE, SCOPE_ALL, SCOPE_QUESTION, SCORE
from assayer.operators import answers as A
from assayer.operators import benchmark as B
from assayer.operators import overlap as O
from assayer.operators import calibration as C
from assayer.operators import leakage as K
from assayer.operators import losses as L
from assayer.operators.metrics import with_target_vectors
from assayer.plans import fixtures as X
from assayer.plans.metric_queries import _SCORE5, _noul_rows, _rounded
from assayer.plans.sql import CHOICE10, fold, r6, softmax
from assayer.session import fresh_path
from assayer.sources.packed import read_temperatures

TEMPERATURES = [("choice:10", 0.7), ("choice", 1.5), ("score", 2.0), ("noul", 0.8)]


def _temperatures(spark):
    return spark.createDataFrame(TEMPERATURES, "key string, value double")


def answers_choice(spark, folder):
    out = A.answers(X.choice10(spark, folder), _temperatures(spark))
    p3 = F.element_at("answer_probabilities", F.lit("3"))
    return _rounded(out.select("id", "choice", "confidence", p3.alias("p3")), "confidence", "p3")


def answers_score(spark, folder):
    rows = X.score5(spark, folder).withColumn(
        "descriptions", F.transform("keys", lambda k: F.concat(F.lit("level "), k))
    )
    out = A.answers(rows, _temperatures(spark))
    return _rounded(
        out.select("id", "score", "confidence", F.element_at("legend", F.lit("4")).alias("top_level")),
        "score", "confidence",
    )


def answers_noul(spark, folder):
    out = A.answers(X.noul2(spark, folder), _temperatures(spark))
    return _rounded(out.select("id", "qid", "noul"), "noul")


def temperature_lookup(spark, folder):
    """Outcome counts 2 to 10 per vector: only count 10 has its own entry."""
    rows = X.choice10(spark, folder).withColumn(
        "keys", F.slice("keys", F.lit(1), F.pmod(F.col("id"), F.lit(9)).cast("int") + 2)
    )
    kinds = F.when(F.col("label") < 8, F.lit(CHOICE)).otherwise(F.lit("other"))
    out = A.with_temperature(rows.withColumn("type", kinds), _temperatures(spark))
    return out.groupBy("type", F.size("keys").alias("k"), "temperature").agg(
        F.count(F.lit(1)).alias("n")
    )


def _rotated(spark, folder):
    rows = X.event_choice(spark, folder).withColumn(
        "names",
        F.when(F.pmod("id", F.lit(3)) == 0, X.names(["kind", "kind#rotation1", "kind#rotation1#"]))
        .otherwise(X.names(["kind"])),
    )
    return A.rotation_variants(rows.drop("logits"), names="names")


def rotation_variants(spark, folder):
    return _rotated(spark, folder).select(
        "id", "rotation", "variant", F.array_join("keys", ",").alias("options")
    )


def rotation_average(spark, folder):
    """A scorer that prefers early positions: averaging over rotations removes the preference."""
    rows = _rotated(spark, folder)
    taste = F.transform(
        "keys", lambda k, i: F.pmod(F.length(k) + F.col("user_id"), F.lit(4)) * 0.5 - i * 0.3
    )
    scored = rows.withColumn("p", X.softmax_of(taste))
    out = A.typed_answers(A.rotation_average(scored))
    return _rounded(
        out.select("id", "choice", F.element_at("answer_probabilities", F.lit("view")).alias("p_view")),
        "p_view",
    )


def usage_tokens(spark, folder):
    docs = X.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.ceil(F.col("n_chars") / 4).alias("state_tokens"),
        F.explode(F.array(
            F.struct(F.lit("a").alias("qid"), F.lit(CHOICE).alias("type"),
                     X.names(["x", "y", "z"]).alias("keys"), F.lit(12).alias("question_tokens")),
            F.struct(F.lit("b").alias("qid"), F.lit(BOOLEAN).alias("type"),
                     X.names(["true", "false"]).alias("keys"), F.lit(7).alias("question_tokens")),
        )).alias("q"),
    ).select("id", "state_tokens", "q.*")
    return A.usage(A.rotation_variants(docs))


def state_reuse(spark, folder):
    """Documents repeat texts: the stand-in encoder runs once per distinct text."""
    docs = X.table(spark, folder, "documents").select("doc_id", "text")
    out = A.shared_states(
        docs, "text", lambda d: d.withColumn("chars", F.length("text")), row_key=F.col("doc_id")
    )
    return out.select("doc_id", "chars", F.col("n").alias("sharing"))


def _cases(spark, folder):
    kind = F.pmod("id", F.lit(3))
    rows = X.choice10(spark, folder).withColumn(
        "type", F.when(kind == 0, CHOICE).when(kind == 1, SCORE).otherwise(BOOLEAN)
    )
    boolean = F.col("type") == BOOLEAN
    cut = lambda a: F.when(boolean, F.slice(a, 1, 2)).otherwise(a)
    p = X.softmax_of(cut(X.dims(0)))
    rows = rows.withColumns(
        {
            "keys": F.when(boolean, X.names(["true", "false"])).otherwise(F.col("keys")),
            "g": X.softmax_of(cut(X.dims(20))),
            "truth": F.get(p, F.lit(0)),
            "answer": F.map_from_arrays(X.names(X.DIGITS), X.softmax_of(X.dims(0))),
            "label": F.when(
                boolean, F.when(F.col("label") < 5, "true").otherwise("false")
            ).otherwise(F.col("label").cast("string")),
        }
    )
    return rows.withColumn(
        "p", B.aligned_distribution(F.col("type"), F.col("truth"), F.col("answer"), F.col("keys"))
    )


def benchmark_metrics(spark, folder):
    out = B.benchmark_report(_cases(spark, folder))
    return _rounded(out, *[c for c in out.columns if c != "decisions"])


def benchmark_answers(spark, folder):
    """Status of every decision when some predictions are missing, repeated or belong to no case."""
    rows = X.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.lit("q").alias("qid"), F.col("label").alias("gold"))
    given = rows.filter("id % 7 > 0").select(F.when(F.col("id") % 50 == 1, F.col("id") + 1_000_000).otherwise(F.col("id")).alias("id"), "qid", F.col("gold").alias("answer"))
    given = given.unionByName(given.filter("id % 31 = 3 and id < 1000000"))
    return B.answered(rows, given).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("answer")).alias("hits"))


def text_overlap_filter(spark, folder):
    return O.text_overlap(X.table(spark, folder, "benchmark"), X.table(spark, folder, "documents"), "item_id")


def macro_f1_pooled(spark, folder):
    return _rounded(B.macro_f1(B.decision_metrics(_cases(spark, folder))), "macro_f1")


def latency_median(spark, folder):
    return _rounded(B.median_latency(X.table(spark, folder, "events"), "value"), "ms_per_case_p50")


def _view_rows(spark, folder):
    return X.choice10(spark, folder, X.dims(10)).select(
        "id", "qid", "logits", F.lit("alternative").alias("view_id"),
        F.lit("paraphrase").alias("method"), "embedding", "label",
    )


def view_consistency(spark, folder):
    base = with_target_vectors(X.choice10(spark, folder))
    out = L.view_consistency(base, _view_rows(spark, folder), 10)
    return _rounded(
        out.select("id", "total_variation", "argmax_agreement", "base_nll", "view_nll"),
        "total_variation", "base_nll", "view_nll",
    )


def _rows_of_dims(count, width, start=0):
    return F.array(
        *[X.cut_dims(start + i * width, width) for i in range(count)]
    )


def _loss_rows(spark, folder):
    base = with_target_vectors(
        X.choice10(spark, folder).withColumns(
            {
                "record_weight": 1.0 + F.pmod("label", F.lit(2)),
                "question_weight": F.lit(1.0),
                "readouts": _rows_of_dims(11, 5),
            }
        )
    )
    view = _view_rows(spark, folder).filter(F.pmod("id", F.lit(5)) != 0).withColumns(
        {
            "scope": F.when(F.pmod("id", F.lit(2)) == 0, SCOPE_ALL).otherwise(SCOPE_QUESTION),
            "readouts": _rows_of_dims(11, 5, 5),
        }
    )
    return L.record_losses(L.paired_losses(base, view, width=10), 0.01)


def record_loss_paired(spark, folder):
    out = _loss_rows(spark, folder)
    return _rounded(out.drop("record_weight"), "loss", "decision_loss", "alignment_loss")


def batch_loss(spark, folder):
    rows = _loss_rows(spark, folder).withColumn("batch", F.pmod("id", F.lit(7)))
    return _rounded(L.batch_loss(rows, ["batch"]), "loss")


def readout_alignment(spark, folder):
    rows = X.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        L.readout_alignment(
            _rows_of_dims(4, 16), F.reverse(_rows_of_dims(4, 16))
        ).alias("alignment"),
        L.mean_distance(_rows_of_dims(4, 16), F.reverse(_rows_of_dims(4, 16))).alias("mean_distance"),
    )
    return _rounded(rows, "alignment", "mean_distance")


def _head():
    row = lambda f: F.array(*[F.lit(f(j)) for j in range(16)])
    w = row(lambda j: ((j * 7) % 5 - 2) / 5.0)
    c = F.array(*[row(lambda j, r=r: ((r * 3 + j) % 7 - 3) / 7.0) for r in range(8)])
    g = F.array(*[row(lambda j, r=r: ((r * 5 + j) % 6 - 2) / 6.0) for r in range(8)])
    return w, c, g


def head_scoring(spark, folder):
    """Logits from stored readouts, and with the global readout removed."""
    w, c, g = _head()
    rows = X.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), _rows_of_dims(4, 16).alias("readouts")
    )
    full, none = L.head_logits(F.col("readouts"), w, c, g), L.head_logits(
        L.zero_global(F.col("readouts")), w, c, g)
    out = rows.select("id", full.alias("full"), none.alias("none"))
    return _rounded(
        out.select("id", *[F.get("full", F.lit(i)).alias(f"z{i}") for i in range(3)],
                   F.get("none", F.lit(0)).alias("without_global")),
        "z0", "z1", "z2", "without_global",
    )


def global_ablation(spark, folder):
    """Loss with and without the global readout; the class modulo three is the right outcome."""
    w, c, g = _head()
    rows = X.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), _rows_of_dims(4, 16).alias("readouts"), (F.col("label") % 3).alias("target"))
    logits = rows.select("target", L.head_logits(F.col("readouts"), w, c, g).alias("full"), L.head_logits(L.zero_global(F.col("readouts")), w, c, g).alias("none"))
    return _rounded(L.global_ablation(logits, "full", "none", "target"), "nll", "zero_g_nll")


def calibration_file(spark, folder):
    """A fit written for its model with the groups it used, read back for that model: usable temperatures, groups, and evaluation groups that the fit has seen."""
    path = fresh_path(spark, "calibration")
    rows = _informed(spark, folder)
    records = rows.select((F.col("id") % 50).cast("string").alias("split_group"))
    C.write_calibration(C.fit_temperatures(with_target_vectors(rows), width=10), records, "m1", path)
    temperatures = read_temperatures(spark, f"{path}/temperatures", "m1")
    bad = A.temperature_violations(temperatures)
    groups = spark.read.parquet(f"{path}/groups")
    asked = spark.range(40, 60).select(F.lit("split_group").alias("key_kind"), F.col("id").cast("string").alias("key"))
    none = asked.limit(0).select(F.lit("").alias("split"), F.lit("").alias("path"), "key_kind", "key")
    sources = none.unionByName(groups.select(F.lit("calibration").alias("split"), F.lit("temperatures").alias("path"), F.lit("split_group").alias("key_kind"), F.col("split_group").alias("key")))
    seen = K.source_overlap(asked, sources, "test")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(temperatures, "temperatures").crossJoin(count(bad, "unusable")).crossJoin(count(groups, "groups")).crossJoin(count(seen, "seen"))  # single rows


def selected_view(spark, folder):
    docs = X.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    views = docs.withColumn(
        "view_index", F.explode(F.sequence(F.lit(0), F.pmod("id", F.lit(3)).cast("int")))
    ).withColumn("view_id", F.concat(F.lit("v"), F.col("view_index").cast("string")))
    chosen = docs.filter(F.pmod("id", F.lit(3)) > 0).withColumn("view_id", F.lit("v1"))
    return L.selected_views(views, chosen).select("id", "view_id", "view_index")


def _informed(spark, folder):
    """Every third vector scores its label higher, so the fit has an inner minimum at any size."""
    bonus = F.transform(
        X.dims(0), lambda z, i: z + F.when((i == F.col("label")) & (F.pmod("vec_id", F.lit(3)) == 0), 2.0).otherwise(0.0))
    return X.choice10(spark, folder, bonus)


def temperature_fit(spark, folder):
    rows = with_target_vectors(_informed(spark, folder))
    fit = C.fit_temperatures(rows, width=10)
    return fit.select(
        "key", F.round("temperature", 4).alias("temperature"), "questions",
        F.round("nll_before", 6).alias("nll_before"), F.round("nll_after", 6).alias("nll_after"),
    )


def temperature_fit_by_count(spark, folder):
    """Choices and true/false questions fitted together, one entry per outcome count."""
    cut = lambda d: with_target_vectors(d).select(
        "type", "kind", "keys", "logits", "t", F.lit(1.0).alias("weight"))
    rows = cut(_informed(spark, folder)).unionByName(
        cut(X.noul2(spark, folder, soft=True).withColumn(
            "logits", F.array((2 * F.col("p_true") - 1) * 1.5, F.get("logits", F.lit(0))))))
    fit = C.fit_temperatures(rows, by_count=True, width=10)
    return fit.select("key", F.round("temperature", 4).alias("temperature"), "questions")


QUERIES = {
    f.__name__: f
    for f in (
        answers_choice, answers_score, answers_noul, temperature_lookup, rotation_variants,
        rotation_average, usage_tokens, state_reuse, benchmark_metrics, benchmark_answers, text_overlap_filter, macro_f1_pooled,
        latency_median, view_consistency, record_loss_paired, batch_loss, readout_alignment,
        head_scoring, global_ablation, calibration_file, selected_view, temperature_fit, temperature_fit_by_count,
    )
}

_CASES = f"""c AS (SELECT vec_id AS id, label, k,
  CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS type,
  exp(4 * ({fold()})) AS ep, exp(4 * ({fold(shift=20)})) AS eg
  FROM embeddings CROSS JOIN range(0, 10) r(k) WHERE vec_id % 3 < 2 OR k < 2),
n AS (SELECT id, label, k, type, ep / sum(ep) OVER (PARTITION BY id) AS p,
  eg / sum(eg) OVER (PARTITION BY id) AS g,
  CASE WHEN type = 'noul' THEN CASE WHEN label < 5 THEN 0 ELSE 1 END ELSE label END AS gold FROM c),
m AS (SELECT *, first_value(k) OVER (PARTITION BY id ORDER BY p DESC, k) AS pred FROM n),
d AS (SELECT id, type, any_value(gold) AS gold, any_value(pred) AS pred,
  CASE WHEN any_value(pred) = any_value(gold) THEN 1.0 ELSE 0.0 END AS hit,
  sum(CASE WHEN k = pred THEN g END) AS soft, sum(g * ln(greatest(g, 1e-12) / greatest(p, 1e-12))) AS kl,
  sum(abs(p - g)) / 2 AS tv, sum((p - g) ** 2) AS brier, max(p) AS top,
  CASE WHEN type = 'score' THEN abs(sum(k * g) - sum(k * p)) END AS gap FROM m GROUP BY id, type)"""

_VIEWS = f"""{CHOICE10}, {softmax()},
z1 AS (SELECT vec_id AS id, label, k, 4 * ({fold(shift=10)}) AS z
  FROM embeddings CROSS JOIN range(0, 10) r(k)), {softmax('z1', 'p1')}"""


def _rows_sql(name: str, count: int, width: int, start: int = 0) -> str:
    return f"""{name} AS (SELECT vec_id AS id, r, j, CAST(embedding[{start} + r * {width} + j + 1] AS DOUBLE) AS v
  FROM embeddings CROSS JOIN range(0, {count}) a(r) CROSS JOIN range(0, {width}) b(j))"""


def _distance_sql(left: str, right: str, on: str) -> str:
    return f"""SELECT x.id, x.r, 1 - sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v))) AS d
  FROM {left} x JOIN {right} y ON x.id = y.id AND x.j = y.j AND {on} GROUP BY x.id, x.r"""


_LOSS = f"""{_VIEWS}, {_rows_sql('ra', 11, 5)}, {_rows_sql('rb', 11, 5, 5)},
dist AS ({_distance_sql('ra', 'rb', 'x.r = y.r')}),
al AS (SELECT id, 0.5 * avg(CASE WHEN r < 10 THEN d END) + 0.5 * max(CASE WHEN r = 10 THEN d END) AS a FROM dist GROUP BY id),
n AS (SELECT p0.id, any_value(p0.label) AS label, sum(CASE WHEN p0.k = p0.label THEN p0.lse - p0.z END) AS b,
  sum(CASE WHEN p1.k = p1.label THEN p1.lse - p1.z END) AS v FROM p0 JOIN p1 ON p0.id = p1.id AND p0.k = p1.k GROUP BY p0.id),
l AS (SELECT n.id, 1.0 + label % 2 AS w, CASE WHEN n.id % 5 <> 0 THEN (b + v) / 2 ELSE b END AS decision_loss,
  CASE WHEN n.id % 5 <> 0 AND n.id % 2 = 0 THEN a ELSE 0 END AS alignment_loss,
  CAST(CASE WHEN n.id % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS paired_questions,
  CAST(CASE WHEN n.id % 5 <> 0 AND n.id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS eligible_questions,
  CAST(CASE WHEN n.id % 5 <> 0 AND n.id % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS scope_skipped_questions
  FROM n JOIN al ON n.id = al.id)"""


def _fit_sql(rows: str, levels: int = 7) -> str:
    """Bisection by refined grids: keep the last inverse temperature with a falling loss."""
    parts = ["fit0 AS (SELECT key, 0.0001 AS lo, 100.0 AS hi FROM (SELECT DISTINCT key FROM f))"]
    for i in range(levels):
        parts.append(
            f"""g{i} AS (SELECT b.key, b.lo + (b.hi - b.lo) * j / 64.0 AS beta, (b.hi - b.lo) / 64.0 AS step
  FROM fit{i} b CROSS JOIN range(0, 65) s(j)),
e{i} AS (SELECT g.key, g.beta, g.step, f.id, sum(exp(f.z * g.beta - f.zmax * g.beta) * f.z) / sum(exp(f.z * g.beta - f.zmax * g.beta)) - sum(f.t * f.z) AS s
  FROM g{i} g JOIN f ON f.key = g.key GROUP BY g.key, g.beta, g.step, f.id),
fit{i + 1} AS (SELECT key, max(CASE WHEN slope < 0 THEN beta END) AS lo, max(CASE WHEN slope < 0 THEN beta END) + any_value(step) AS hi
  FROM (SELECT key, beta, step, avg(s) AS slope FROM e{i} GROUP BY key, beta, step) GROUP BY key)"""
        )
    return f"f AS ({rows}), " + ", ".join(parts)


_FIT_CHOICE = _fit_sql(
    "SELECT 'choice' AS key, id, k, z, max(z) OVER (PARTITION BY id) AS zmax, "
    "CASE WHEN k = label THEN 1.0 ELSE 0.0 END AS t FROM z0"
)
_FIT_ALL = _fit_sql(
    "SELECT 'choice:10' AS key, 'c' || id AS id, k, z, max(z) OVER (PARTITION BY id) AS zmax, "
    "CASE WHEN k = label THEN 1.0 ELSE 0.0 END AS t FROM z0 UNION ALL "
    "SELECT 'noul:2', 'n' || id || qid, k, CASE WHEN k = 1 THEN x ELSE (2 * pt - 1) * 1.5 END, greatest(x, (2 * pt - 1) * 1.5), "
    "CASE WHEN k = 0 THEN pt ELSE 1 - pt END FROM q2 CROSS JOIN range(0, 2) r(k)"
)
_INFORMED = CHOICE10.replace("AS z\n", "+ CASE WHEN k = label AND vec_id % 3 = 0 THEN 2.0 ELSE 0.0 END AS z\n")

ORACLE = {
    "benchmark_answers": """WITH g AS (SELECT vec_id AS id, label AS gold FROM embeddings),
p AS (SELECT CASE WHEN id % 50 = 1 THEN id + 1000000 ELSE id END AS id, gold AS answer FROM g WHERE id % 7 > 0),
a AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE id % 31 = 3 AND id < 1000000),
c AS (SELECT coalesce(x.id, y.id) AS id, CASE WHEN y.n IS NULL THEN 'missing' WHEN x.n IS NULL THEN 'unexpected'
  WHEN x.n > 1 OR y.n > 1 THEN 'repeated' ELSE 'ok' END AS status
  FROM (SELECT id, count(*) AS n FROM g GROUP BY 1) x FULL JOIN (SELECT id, count(*) AS n FROM a GROUP BY 1) y ON x.id = y.id)
SELECT status, count(*) AS n, count(*) FILTER (WHERE gold = answer) AS hits FROM c LEFT JOIN g USING (id) LEFT JOIN a USING (id) GROUP BY 1""",
    "text_overlap_filter": """WITH t AS (SELECT 'i' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
w AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS a FROM t),
g AS (SELECT DISTINCT side, id, array_to_string(a[i:i + 7], ' ') AS gram FROM w, unnest(range(1, len(a) - 6)) AS u(i)),
s AS (SELECT DISTINCT gram FROM g WHERE side = 'd')
SELECT b.item_id, count(g.gram) AS grams, count(s.gram) AS seen
FROM benchmark b LEFT JOIN g ON g.side = 'i' AND g.id = b.item_id LEFT JOIN s ON s.gram = g.gram GROUP BY 1""",
    "answers_choice": f"""WITH {CHOICE10.replace('4 * (', '1 / 0.7 * 4 * (')}, {softmax()}
SELECT id, CAST(any_value(mode) AS VARCHAR) AS choice, {r6('greatest(0, (any_value(top) - 0.1) / 0.9)')} AS confidence,
  {r6('sum(CASE WHEN k = 3 THEN p END)')} AS p3 FROM p0 GROUP BY id""",
    "answers_score": f"""WITH {_SCORE5.split(', p0_m AS')[0].replace(' AS z', ' AS z_raw').replace('b AS (', 'b_raw AS (')},
b AS (SELECT id, level, k, z_raw / 2.0 AS z FROM b_raw), {softmax('b')}
SELECT id, {r6('sum(k * p)')} AS score, {r6('greatest(0, 1 - sum(p * abs(k - mode)) / 1.2)')} AS confidence,
  'level 4' AS top_level FROM p0 GROUP BY id""",
    "answers_noul": f"""WITH {_noul_rows(False)} SELECT id, qid, {r6('1 / (1 + exp(-x / 0.8))')} AS noul FROM q""",
    "temperature_lookup": """SELECT CASE WHEN label < 8 THEN 'choice' ELSE 'other' END AS type,
  CAST(vec_id % 9 + 2 AS INTEGER) AS k,
  CAST(CASE WHEN label >= 8 THEN 1.0 WHEN vec_id % 9 + 2 = 10 THEN 0.7 ELSE 1.5 END AS DOUBLE) AS temperature, count(*) AS n
FROM embeddings GROUP BY 1, 2, 3""",
    "rotation_variants": """SELECT event_id AS id, CAST(r AS INTEGER) AS rotation,
  CASE WHEN r = 0 THEN 'kind' WHEN r = 1 AND event_id % 3 = 0 THEN 'kind#rotation1##' ELSE 'kind#rotation' || r END AS variant,
  substr('click,error,purchase,signup,view,click,error,purchase,signup,view',
    [1, 7, 13, 22, 29][r + 1], 32 - CASE WHEN r = 0 THEN 0 ELSE 0 END) AS options
FROM events CROSS JOIN range(0, 5) t(r)""",
    "rotation_average": f"""WITH v AS (SELECT event_id AS id, user_id, r, k,
  ((length(['click', 'error', 'purchase', 'signup', 'view'][k + 1]) + user_id) % 4) * 0.5 - ((k - r + 5) % 5) * 0.3 AS z
  FROM events CROSS JOIN range(0, 5) t(r) CROSS JOIN range(0, 5) s(k)),
s AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY id, r) AS p FROM v),
a AS (SELECT id, k, round(avg(p), 12) AS p FROM s GROUP BY id, k)
SELECT id, first(['click', 'error', 'purchase', 'signup', 'view'][k + 1] ORDER BY p DESC, k) AS choice,
  {r6('max(CASE WHEN k = 4 THEN p END)')} AS p_view FROM a GROUP BY id""",
    "usage_tokens": """SELECT doc_id AS id, CAST(ceil(n_chars / 4.0) AS BIGINT) + 19 AS input_tokens, 0 AS output_tokens FROM documents""",
    "state_reuse": """SELECT doc_id, length(text) AS chars, count(*) OVER (PARTITION BY text) AS sharing FROM documents""",
    "benchmark_metrics": f"""WITH {_CASES},
b AS (SELECT least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, sum(hit) AS h, sum(top) AS t FROM d GROUP BY 1)
SELECT count(*) AS decisions, {r6('avg(hit)')} AS accuracy, {r6('avg(soft)')} AS soft_accuracy,
  {r6('avg(kl)')} AS kl_from_gold, {r6('avg(tv)')} AS tv, {r6('avg(brier)')} AS brier,
  {r6('(SELECT sum(abs(h - t)) FROM b) / count(*)')} AS ece_top_label, {r6('avg(gap)')} AS score_mae,
  {r6('avg(CASE WHEN gap <= 1 THEN 1.0 WHEN gap > 1 THEN 0.0 END)')} AS within_one_level FROM d""",
    "macro_f1_pooled": f"""WITH {_CASES},
l AS (SELECT CASE WHEN type = 'noul' THEN ['true', 'false'][pred + 1] ELSE CAST(pred AS VARCHAR) END AS a,
  CASE WHEN type = 'noul' THEN ['true', 'false'][gold + 1] ELSE CAST(gold AS VARCHAR) END AS b FROM d),
u AS (SELECT a AS name FROM l UNION SELECT b FROM l),
f AS (SELECT name, 2.0 * sum(CASE WHEN a = name AND b = name THEN 1 ELSE 0 END) /
  (sum(CASE WHEN a = name THEN 1 ELSE 0 END) + sum(CASE WHEN b = name THEN 1 ELSE 0 END)) AS f1
  FROM u, l GROUP BY name)
SELECT {r6('avg(f1)')} AS macro_f1, count(*) AS labels FROM f""",
    "latency_median": f"SELECT {r6('median(value)')} AS ms_per_case_p50 FROM events",
    "view_consistency": f"""WITH {_VIEWS}
SELECT p0.id, {r6('sum(abs(p0.p - p1.p)) / 2')} AS total_variation,
  CAST(any_value(p0.mode) = any_value(p1.mode) AS INTEGER) AS argmax_agreement,
  {r6('sum(CASE WHEN p0.k = p0.label THEN p0.lse - p0.z END)')} AS base_nll,
  {r6('sum(CASE WHEN p1.k = p1.label THEN p1.lse - p1.z END)')} AS view_nll
FROM p0 JOIN p1 ON p0.id = p1.id AND p0.k = p1.k GROUP BY p0.id""",
    "record_loss_paired": f"""WITH {_LOSS}
SELECT id, {r6('decision_loss')} AS decision_loss, {r6('alignment_loss')} AS alignment_loss,
  paired_questions, eligible_questions, scope_skipped_questions,
  {r6('decision_loss + 0.01 * alignment_loss')} AS loss FROM l""",
    "batch_loss": f"""WITH {_LOSS}
SELECT id % 7 AS batch, {r6('sum(w * (decision_loss + 0.01 * alignment_loss)) / sum(w)')} AS loss, count(*) AS records
FROM l GROUP BY 1""",
    "readout_alignment": f"""WITH {_rows_sql('ra', 4, 16)}, d AS ({_distance_sql('ra', 'ra', 'x.r = 3 - y.r')})
SELECT id, {r6('0.5 * avg(CASE WHEN r < 3 THEN d END) + 0.5 * max(CASE WHEN r = 3 THEN d END)')} AS alignment,
  {r6('avg(d)')} AS mean_distance FROM d GROUP BY id""",
    "head_scoring": f"""WITH {_rows_sql('h', 4, 16)},
wh AS (SELECT id, r, sum(v * ((j * 7) % 5 - 2) / 5.0) AS lin FROM h GROUP BY id, r),
ch AS (SELECT id, h.r, q, sum(v * ((q * 3 + j) % 7 - 3) / 7.0) AS c, sum(v * ((q * 5 + j) % 6 - 2) / 6.0) AS g
  FROM h CROSS JOIN range(0, 8) t(q) GROUP BY id, h.r, q),
z AS (SELECT a.id, a.r, sum(a.c * b.g) / 16.0 AS inter FROM ch a JOIN ch b ON a.id = b.id AND a.q = b.q AND b.r = 3
  WHERE a.r < 3 GROUP BY a.id, a.r)
SELECT z.id, {r6('max(CASE WHEN z.r = 0 THEN lin + inter END)')} AS z0, {r6('max(CASE WHEN z.r = 1 THEN lin + inter END)')} AS z1,
  {r6('max(CASE WHEN z.r = 2 THEN lin + inter END)')} AS z2, {r6('max(CASE WHEN z.r = 0 THEN lin END)')} AS without_global
FROM z JOIN wh ON z.id = wh.id AND z.r = wh.r GROUP BY z.id""",
    "global_ablation": f"""WITH {_rows_sql('h', 4, 16)},
wh AS (SELECT id, r, sum(v * ((j * 7) % 5 - 2) / 5.0) AS lin FROM h GROUP BY id, r),
ch AS (SELECT id, h.r, q, sum(v * ((q * 3 + j) % 7 - 3) / 7.0) AS c, sum(v * ((q * 5 + j) % 6 - 2) / 6.0) AS g
  FROM h CROSS JOIN range(0, 8) t(q) GROUP BY id, h.r, q),
z AS (SELECT a.id, a.r, sum(a.c * b.g) / 16.0 AS inter FROM ch a JOIN ch b ON a.id = b.id AND a.q = b.q AND b.r = 3
  WHERE a.r < 3 GROUP BY a.id, a.r),
n AS (SELECT z.id, ln(sum(exp(lin + inter))) - sum(CASE WHEN z.r = label % 3 THEN lin + inter END) AS f_nll,
  ln(sum(exp(lin))) - sum(CASE WHEN z.r = label % 3 THEN lin END) AS z_nll
  FROM z JOIN wh ON z.id = wh.id AND z.r = wh.r JOIN embeddings e ON e.vec_id = z.id GROUP BY z.id)
SELECT count(*) AS questions, {r6('avg(f_nll)')} AS nll, {r6('avg(z_nll)')} AS zero_g_nll, count(*) FILTER (WHERE f_nll < z_nll) AS helped FROM n""",
    "calibration_file": """WITH g AS (SELECT DISTINCT CAST(vec_id % 50 AS VARCHAR) AS k FROM embeddings)
SELECT 1 AS temperatures, 0 AS unusable, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g JOIN range(40, 60) r(i) ON k = CAST(i AS VARCHAR)) AS seen""",
    "selected_view": "SELECT doc_id AS id, 'v1' AS view_id, 1 AS view_index FROM documents WHERE doc_id % 3 > 0",
    "temperature_fit": f"""WITH {_INFORMED}, {_FIT_CHOICE},
n AS (SELECT f.id, ln(sum(exp(z))) - sum(t * z) AS b, ln(sum(exp(z * lo))) - lo * sum(t * z) AS a
  FROM f JOIN fit7 USING (key) GROUP BY f.id, lo)
SELECT 'choice' AS key, round((SELECT 1 / lo FROM fit7), 4) AS temperature, count(*) AS questions,
  {r6('avg(b)')} AS nll_before, {r6('avg(a)')} AS nll_after FROM n""",
    "temperature_fit_by_count": f"""WITH {_INFORMED}, {_noul_rows(True).replace('b AS (', 'bn AS (', 1).replace('FROM b)', 'FROM bn)').replace('c AS (SELECT *, y', 'cn AS (SELECT *, y').replace('dbrier FROM c)', 'dbrier FROM cn)').replace('q AS (', 'q2 AS (')},
{_FIT_ALL}
SELECT key, round(1 / lo, 4) AS temperature, (SELECT count(DISTINCT id) FROM f WHERE f.key = fit7.key) AS questions FROM fit7""",
}
