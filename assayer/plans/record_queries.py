"""Adapters, record rules, strict JSON, views and request projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.constants import SCHEMA_VERSION, SCOPE_ALL, VIEW_RELATION
from assayer.functions import json as J
from assayer.operators import adapters as A
from assayer.operators import records as R
from assayer.operators import validate as V
from assayer.plans import fixtures as X
from assayer.plans.sql import fold

LANGS = {"en": "English", "de": "German", "fr": "French"}
BOOLEAN_Q = {"type": "noul", "instructions": "Is it good?"}
LANG_Q = {"type": "choice", "instructions": "Which language?", "criteria": LANGS}
PRIORITY_Q = {"type": "score", "criteria": ["urgent", "high", "medium", "unset", "low"]}


def _shape(df):
    """One comparable row per normalized record."""
    t = F.get("targets", F.lit(0))
    return df.select(
        "id", "split_group",
        t["value"].alias("value"), F.round(t["p_true"], 6).alias("p_true"),
        F.size("violations").alias("errors"),
        F.get("violations", F.lit(0))["rule"].alias("rule"),
    )


def _docs(spark, folder):
    return X.table(spark, folder, "documents").withColumnRenamed("doc_id", "id")


def adapter_classification(spark, folder):
    """Language as a three-way choice; the fourth language has no outcome and is rejected."""
    config = {"adapter": "classification", "fields": {"label": "lang", "split_group": "source"},
              "question": LANG_Q}
    return _shape(A.normalize(_docs(spark, folder), config, "lang")).drop("p_true")


def adapter_binary(spark, folder):
    rows = _docs(spark, folder).join(
        X.table(spark, folder, "labels").withColumnRenamed("doc_id", "id"), "id")
    config = {"adapter": "binary", "fields": {"label": "quality", "split_group": "source"},
              "label_type": "integer", "question": BOOLEAN_Q,
              "label_map": [{"source": 1, "target": 0.95}, {"source": "0", "target": 0.5},
                            {"source": 0, "target": 0.05}]}
    return _shape(A.normalize(rows, config, "quality")).drop("value")


def adapter_bernoulli(spark, folder):
    """Soft truth values; those outside [0, 1] are rejected."""
    rows = X.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("text"),
        (F.col("value") / 250.0).alias("p_true"), F.col("user_id").cast("string").alias("split_group"))
    config = {"adapter": "binary", "target_kind": "bernoulli", "question": BOOLEAN_Q}
    return _shape(A.normalize(rows, config, "soft")).select("id", "p_true", "errors")


def adapter_ordinal(spark, folder):
    rows = X.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text"), "o_orderpriority",
        F.col("o_custkey").cast("string").alias("split_group"))
    config = {"adapter": "ordinal", "fields": {"label": "o_orderpriority"}, "question": PRIORITY_Q,
              "label_map": [{"source": "1-URGENT", "target": "0"}, {"source": "2-HIGH", "target": "1"},
                            {"source": "3-MEDIUM", "target": "2"}, {"source": "5-LOW", "target": "4"},
                            {"source": "4-NOT SPECIFIED", "target": "9"}]}
    return _shape(A.normalize(rows, config, "priority")).drop("p_true")


def adapter_pair(spark, folder):
    rows = X.table(spark, folder, "customer").withColumns(
        {"id": F.col("c_custkey"), "rich": (F.col("c_acctbal") > 0)})
    config = {"adapter": "pair", "state_fields": {"segment": "c_mktsegment", "nation": "c_nationkey"},
              "fields": {"label": "rich"}, "label_type": "boolean", "question": BOOLEAN_Q}
    out = A.normalize(rows, config, "rich")
    return out.select("id", F.col("request.state_json").alias("state_json"),
                      F.get("targets", F.lit(0))["p_true"].alias("p_true"), "split_group_inferred")


def adapter_instruction(spark, folder):
    rows = X.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("input"), F.col("p_type").alias("instruction"),
        F.when(F.col("p_size") > 25, "large").otherwise("small").alias("label"),
        F.col("p_brand").alias("split_group"))
    config = {"adapter": "instruction",
              "question": {"type": "choice", "criteria": {"large": None, "small": "up to 25"}}}
    out = A.normalize(rows, config, "size")
    q = F.get("request.questions", F.lit(0))
    return out.select("id", q["instructions_json"].alias("instructions"),
                      F.get("targets", F.lit(0))["value"].alias("value"), F.size("violations").alias("errors"))


def adapter_chat_label(spark, folder):
    """Only [system?, user, assistant] conversations whose last text is a label are accepted. The
    labels here are lengths in words, so the share of exact labels is the data's own."""
    turns = X.table(spark, folder, "conversations")
    label = F.when(F.pmod("conv_id", F.lit(4)) == 0, F.col("text")).otherwise(
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "yes").otherwise("no"))
    text = F.when((F.col("role") == "assistant"), label).otherwise(F.col("text"))
    rows = turns.groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", text.alias("content")))).alias("m")
    ).select("id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
             .alias("messages"), F.col("id").cast("string").alias("split_group"))
    config = {"adapter": "chat_label",
              "question": {"type": "choice", "instructions": "Answer", "criteria": {"yes": None, "no": None}}}
    return _shape(A.normalize(rows, config, "chat")).select("id", "value", "rule")


def adapter_dynamic_choice(spark, folder):
    """Per-row option lists; the answer is an index, and index 4 is sometimes outside the list."""
    rows = X.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("props").alias("state"), F.lit("Pick").alias("instructions"),
        F.slice(X.names(X.EVENT_TYPES), F.lit(1), F.pmod("user_id", F.lit(3)).cast("int") + 3).alias("choices"),
        (F.array_position(X.names(X.EVENT_TYPES), F.col("event_type")) - 1).alias("label"),
        F.col("user_id").cast("string").alias("split_group"))
    config = {"adapter": "dynamic_choice", "answer_encoding": "index"}
    return _shape(A.normalize(rows, config, "event")).select("id", "value", "errors")


def adapter_distribution(spark, folder):
    """Probability lists in a declared order that differs from the order of the outcomes."""
    rows = X.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"),
        X.softmax_of(X.dims(0, 3)).alias("probabilities"), F.lit("g").alias("split_group"))
    config = {"adapter": "classification", "target_kind": "distribution",
              "probability_order": ["fr", "en", "de"], "question": LANG_Q}
    out = A.normalize(rows, config, "soft")
    d = F.get("targets", F.lit(0))["dist"]
    return out.select("id", *[F.round(F.get(d, F.lit(i)), 6).alias(k) for i, k in enumerate(LANGS)],
                      F.size("violations").alias("errors"))


def adapter_allowed_set(spark, folder):
    rows = X.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text",
        F.array("lang", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("lang")).otherwise("en")).alias("allowed"),
        F.col("source").alias("split_group"))
    config = {"adapter": "classification", "target_kind": "allowed_set", "question": LANG_Q}
    out = A.normalize(rows, config, "set")
    return out.select("id", F.get("violations", F.lit(0))["rule"].alias("rule"))


def multilabel_complete(spark, folder):
    rows = X.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("text"),
        F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")),
                 lambda x: x.isNotNull()).alias("labels"), F.lit("g").alias("split_group"))
    config = {"adapter": "multilabel_complete", "instructions": "Tag",
              "label_criteria": {"quality": "good", "toxic": "bad", "spam": "junk"}}
    out = A.accepted(A.normalize(rows, config, "tags"))
    q = R.exploded_questions(out, supervised=True)
    return q.select("id", "qid", "p_true", F.round("weight", 6).alias("weight"))


def multilabel_partial(spark, folder):
    rows = X.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("text"),
        F.create_map(F.lit("quality"), F.col("quality") == 1, F.lit("toxic"),
                     F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("toxic") == 1)).alias("label_states"),
        F.lit("g").alias("split_group"))
    config = {"adapter": "multilabel_partial", "instructions": "Tag",
              "label_criteria": {"quality": "good", "toxic": "bad"}}
    out = A.accepted(A.normalize(rows, config, "tags"))
    return R.exploded_questions(out, supervised=True).select("id", "qid", "p_true", "weight")


def label_map_typed(spark, folder):
    """The strings "1" and "x1" under an integer declaration; a string entry never matches."""
    rows = X.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.lit("t").alias("text"), F.lit("g").alias("split_group"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat(F.lit("x"), F.col("quality").cast("string")))
        .otherwise(F.col("quality").cast("string")).alias("label"))
    config = {"adapter": "classification", "label_type": "integer",
              "question": {"type": "choice", "criteria": {"lo": "", "hi": ""}},
              "label_map": [{"source": "1", "target": "lo"}, {"source": True, "target": "lo"},
                            {"source": 1, "target": "hi"}, {"source": 0, "target": "lo"}]}
    return _shape(A.normalize(rows, config, "typed")).select("id", "value", "rule")


def record_digest_ids(spark, folder):
    """Ids and split groups derived from content digests."""
    rows = X.table(spark, folder, "documents").select("text", "lang")
    config = {"adapter": "classification", "fields": {"label": "lang"},
              "question": {"type": "choice", "criteria": {k: None for k in ("en", "de", "fr", "es")}}}
    out = A.normalize(rows, config, "lang")
    return out.select("id", "split_group", "split_group_inferred",
                      F.get("targets", F.lit(0))["value"].alias("value"))


def view_from_state(spark, folder):
    """A second state column becomes a verified view; unverified rows keep their record."""
    rows = _docs(spark, folder).select(
        "id", "text", "lang", F.col("source").alias("split_group"), F.upper("text").alias("other"),
        F.struct((F.pmod("id", F.lit(4)) != 0).alias("verified"), F.lit(VIEW_RELATION).alias("relation"),
                 F.lit("upper case").alias("method"), F.lit("r1").alias("reference"),
                 F.lit(SCOPE_ALL).alias("readout_scope")).alias("view_verification"))
    config = {"adapter": "classification", "fields": {"label": "lang"}, "view_state_field": "other",
              "question": {"type": "choice", "criteria": {k: None for k in ("en", "de", "fr", "es")}}}
    out = V.audit_views(A.accepted(A.normalize(rows, config, "lang")))
    return out.select("id", F.size("accepted_views").alias("accepted"),
                      F.concat_ws(",", F.flatten(F.transform("rejected_views", lambda r: r["reasons"]))).alias("reasons"))


# One record text per event. The damage done to it is a function of the event id.
DAMAGE = (
    ("ok", None), ("duplicate_key", "strict_json"), ("nan", "strict_json"), ("overflow", "finite_json"),
    ("trailing", "strict_json"), ("bool_number", "weight"), ("unknown_field", "unknown_fields"),
    ("sum", "distribution_sum"), ("empty_qid", "question_id"), ("extra_target", "targets"),
    ("version", "schema_version"), ("zero_weight", "weight"), ("bad_class", "class_value"),
    ("allowed_repeat", "allowed_outcome"), ("null_level", "score_description"), ("noul_kind", "noul_target"),
)


def _record_texts(spark, folder):
    n = len(DAMAGE)
    rows = X.table(spark, folder, "events").withColumn("d", F.pmod("event_id", F.lit(n)).cast("int"))
    hit = lambda name: F.col("d") == [x[0] for x in DAMAGE].index(name)
    pick = lambda name, bad, good: F.when(hit(name), F.lit(bad)).otherwise(F.lit(good))
    text = F.concat(
        F.lit('{"schema_version":"'), pick("version", "v0", SCHEMA_VERSION), F.lit('","id":"e'),
        F.col("event_id").cast("string"), F.lit('","task_id":"event",'),
        pick("duplicate_key", '"task_id":"event",', ""),
        pick("unknown_field", '"extra":1,', ""),
        F.lit('"request":{"state":'), F.col("props"), F.lit(',"questions":{"kind":{"type":"choice",'
              '"instructions":"Which?","criteria":{"click":"c","error":null,"purchase":{"a":[1]},"signup":"","view":"v"}},'
              '"level":{"type":"score","criteria":["lo",'), pick("null_level", "null", '"mid"'), F.lit(',"hi"]},"'),
        pick("empty_qid", "", "sure"), F.lit('":{"type":"noul"}}},"targets":{"kind":'),
        F.when(hit("bad_class"), F.lit('{"kind":"class","value":"other"}'))
        .when(hit("allowed_repeat"), F.lit('{"kind":"allowed_set","values":["click","click"]}'))
        .otherwise(F.concat(F.lit('{"kind":"class","value":"'), F.col("event_type"), F.lit('"}'))),
        F.lit(',"level":{"kind":"distribution","values":{"0":0.25,"1":0.25,"2":'), pick("sum", "0.4", "0.5"),
        F.lit("}}"), F.when(hit("empty_qid"), F.lit("")).when(
            hit("noul_kind"), F.lit(',"sure":{"kind":"class","value":"true"}')).otherwise(
            F.lit(',"sure":{"kind":"bernoulli","p_true":1}')),
        pick("extra_target", ',"ghost":{"kind":"bernoulli","p_true":1}', ""),
        F.lit('},"metadata":{"split_group":"u'), F.col("user_id").cast("string"), F.lit('","note":'),
        F.when(hit("nan"), "NaN").when(hit("overflow"), "-1e999").otherwise('"1e999 NaN"'),
        F.lit('},"weight":'), F.when(hit("bool_number"), "true").when(hit("zero_weight"), "0").otherwise("1.5"),
        F.lit(',"question_weights":{"kind":2}}'), pick("trailing", " {}", ""),
    )
    return rows.select("event_id", "d", V.evaluated_once(text).alias("value"))


def strict_json(spark, folder):
    rows = _record_texts(spark, folder)
    return rows.select("event_id", J.strict(F.col("value")).cast("int").alias("strict"),
                       J.finite(F.col("value")).cast("int").alias("finite"))


def record_rules(spark, folder):
    """First broken rule of each record text; undamaged records have none."""
    out = V.validated(R.parse_records(_record_texts(spark, folder), "value", views=False))
    broken = F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["rule"])))
    return out.select("event_id", F.concat_ws(",", broken).alias("rules"))


def quarantine_counts(spark, folder):
    return V.violation_counts(R.parse_records(_record_texts(spark, folder), "value", views=False))


def parsed_questions(spark, folder):
    """Supervised questions of accepted records, with ordered options and weights."""
    good, _ = V.quarantine(R.parse_records(_record_texts(spark, folder), "value", views=False))
    q = R.exploded_questions(good, supervised=True)
    return q.select("id", "qid", "q_pos", F.array_join("keys", "|").alias("keys"),
                    F.round("weight", 6).alias("weight"), "split_group")


def model_visible(spark, folder):
    good, _ = V.quarantine(R.parse_records(_record_texts(spark, folder), "value", views=False))
    return good.select("id", R.model_inputs(good).alias("visible"), "dataset")


def request_admission(spark, folder):
    """Request bodies: wrong model names, broken JSON and empty bodies are refused."""
    rows = X.table(spark, folder, "events")
    k = F.pmod("event_id", F.lit(6))
    body = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.concat(F.col("props"), F.lit(",")))
        .when(k == 2, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .when(k == 3, F.concat(F.lit('{"model":"other","p":'), F.col("props"), F.lit("}")))
        .when(k == 4, F.concat(F.lit('{"model":"m1","p":'), F.col("props"), F.lit("}")))
        .otherwise(F.col("props"))
    )
    out = V.admission(rows.select("event_id", body.alias("value")), model="m1")
    return out.select("event_id", F.coalesce("admission", F.lit("ok")).alias("admission"))


def adapter_native(spark, folder):
    """Rows that hold whole requests and targets, with weights of records and questions; a reviewed hook turns the order of the options, and bad weights are refused."""
    request = F.concat(F.lit('{"state":'), F.col("props"), F.lit(',"questions":{"kind":{"type":"choice","criteria":{"click":null,"error":null,"purchase":null,"signup":null,"view":null}}}}'))
    rows = X.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), request.alias("request"), F.concat(F.lit('{"kind":{"kind":"class","value":"'), F.col("event_type"), F.lit('"}}')).alias("targets"),
        (F.col("event_id") % 5).cast("double").alias("weight"),
        F.create_map(F.lit("kind"), F.when(F.col("event_id") % 7 == 0, -1.0).otherwise(2.0)).alias("question_weights"),
        F.col("user_id").cast("string").alias("split_group"))

    def turned(records):
        """The options in reverse order, in keys and descriptions alike."""
        def one(q):
            for name in ("criteria_keys", "descriptions", "description_kinds", "keys"):
                q = q.withField(name, F.reverse(q[name]))
            return q

        return records.withColumn("request", F.col("request").withField("questions", F.transform(F.col("request.questions"), one)))

    out = A.normalize(rows, {"adapter": "native"}, "native", hook=turned)
    q = F.get("request.questions", F.lit(0))
    rules = F.array_join(F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["rule"]))), ",")
    return out.select("id", F.array_join(q["keys"], "|").alias("keys"), "weight", F.get("question_weights", F.lit(0))["weight"].alias("question_weight"), rules.alias("rules"))


def _with_views(spark, folder):
    """Records with three views each; which rule a view breaks depends on the vector id."""
    rows = X.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("vid"), F.col("label").cast("string").alias("label"))
    q = lambda keys: '{"type":"choice","criteria":{' + ",".join(f'"{k}":""' for k in keys) + "}}"
    base = q(X.DIGITS)
    swapped = q(["1", "0", *X.DIGITS[2:]])
    m = F.pmod("vid", F.lit(7))
    second = F.concat(
        F.lit('{"view_id":"'), F.when(m == 1, "a").otherwise("b"), F.lit('","request":{"state":"s2","questions":{"'),
        F.when(m == 2, "zz").otherwise("q"), F.lit('":'), F.when(m == 3, swapped).otherwise(base),
        F.lit('}},"equivalence":{"verified":'), F.when(m == 4, "1").otherwise("true"),
        F.lit(',"relation":"'), F.when(m == 5, "same_label").otherwise(VIEW_RELATION),
        F.lit('","method":"m","reference":"'), F.when(m == 6, "").otherwise("r"), F.lit('"}}'))
    view = lambda vid: F.lit(
        f'{{"view_id":"{vid}","request":{{"state":"s1","questions":{{"q":{base}}}}},"equivalence":'
        f'{{"verified":true,"relation":"{VIEW_RELATION}","method":"m","reference":"r"}}}}')
    text = F.concat(
        F.lit(f'{{"schema_version":"{SCHEMA_VERSION}","id":"v'), F.col("vid").cast("string"),
        F.lit(f'","task_id":"t","request":{{"state":"s","questions":{{"q":{base}}}}},"targets":{{"q":'
              '{"kind":"class","value":"'), F.col("label"), F.lit('"}},"views":['), view("a"), F.lit(","), second,
        F.lit(',7]}'))
    return R.parse_records(rows.select("vid", V.evaluated_once(text).alias("value")), "value")


def view_audit(spark, folder):
    out = V.audit_views(_with_views(spark, folder))
    reasons = F.transform("rejected_views", lambda r: F.concat(r["index"].cast("string"), F.lit(":"), F.get(F.filter(
        r["reasons"], lambda x: x != "question_subset"), F.lit(0))))
    return out.select("vid", F.size("accepted_views").alias("accepted"), F.array_join(reasons, ",").alias("reasons"),
                      F.size("violations").alias("errors")) if "violations" in out.columns else out.select(
        "vid", F.size("accepted_views").alias("accepted"), F.array_join(reasons, ",").alias("reasons"))


def validation_report(spark, folder):
    return V.validation_report(_with_views(spark, folder))


def nested_requests(spark, folder):
    """Base and view requests of every record as rows."""
    out = R.all_requests(_with_views(spark, folder))
    return out.groupBy("view_index", F.col("request.state_json").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def dataset_names(spark, folder):
    rows = X.table(spark, folder, "documents").select(
        F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit('{"dataset":"'), F.col("lang"), F.lit('"}')))
        .when(F.pmod("doc_id", F.lit(3)) == 1, F.lit('{"dataset":""}')).otherwise(F.lit("{}")).alias("metadata_json"))
    return R.with_metadata(rows).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        adapter_classification, adapter_binary, adapter_bernoulli, adapter_ordinal, adapter_pair,
        adapter_instruction, adapter_chat_label, adapter_dynamic_choice, adapter_distribution,
        adapter_allowed_set, multilabel_complete, multilabel_partial, label_map_typed,
        record_digest_ids, view_from_state, adapter_native, strict_json, record_rules, quarantine_counts,
        parsed_questions, model_visible, request_admission, view_audit, validation_report,
        nested_requests, dataset_names,
    )
}

_RULES = "CASE event_id % 16 " + " ".join(
    f"WHEN {i} THEN '{rule or ''}'" for i, (_n, rule) in enumerate(DAMAGE)) + " END"
_SOFT3 = {i: f"exp(4 * ({fold(str(i - 1), count=3)}))" for i in (1, 2, 3)}
_SOFTSUM = "(" + " + ".join(_SOFT3.values()) + ")"

ORACLE = {
    "adapter_classification": """SELECT CAST(doc_id AS VARCHAR) AS id, source AS split_group,
  CASE WHEN lang <> 'es' THEN lang END AS value, CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS errors,
  CASE WHEN lang = 'es' THEN 'unmapped_label' END AS rule FROM documents""",
    "adapter_binary": """SELECT CAST(doc_id AS VARCHAR) AS id, source AS split_group,
  CASE WHEN quality = 1 THEN 0.95 ELSE 0.05 END AS p_true, 0 AS errors, NULL AS rule FROM documents JOIN labels USING (doc_id)""",
    "adapter_bernoulli": """SELECT CAST(event_id AS VARCHAR) AS id, round(value / 250.0, 6) AS p_true,
  CASE WHEN value / 250.0 > 1 THEN 1 ELSE 0 END AS errors FROM events""",
    "adapter_ordinal": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS split_group,
  CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '1' WHEN '3-MEDIUM' THEN '2' WHEN '5-LOW' THEN '4' ELSE '9' END AS value,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS errors,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'label_map_outside' END AS rule FROM orders""",
    "adapter_pair": """SELECT CAST(c_custkey AS VARCHAR) AS id,
  '{"segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}' AS state_json,
  CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END AS p_true, true AS split_group_inferred FROM customer""",
    "adapter_instruction": """SELECT CAST(p_partkey AS VARCHAR) AS id, '"' || p_type || '"' AS instructions,
  CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS value, 0 AS errors FROM part""",
    "adapter_chat_label": """WITH c AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles,
  last(CASE WHEN conv_id % 4 = 0 THEN text WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'no' END ORDER BY turn) AS answer
  FROM conversations GROUP BY conv_id),
d AS (SELECT *, roles IN ('user,assistant', 'system,user,assistant') AS ok, answer IN ('yes', 'no') AS known FROM c)
SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN ok AND known THEN answer END AS value,
  CASE WHEN NOT ok THEN 'chat_roles' WHEN NOT known THEN 'unmapped_label' END AS rule FROM d""",
    "adapter_dynamic_choice": """WITH e AS (SELECT event_id, user_id % 3 + 3 AS n,
  list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS i FROM events)
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN i < n THEN CAST(i AS VARCHAR) END AS value,
  CASE WHEN i < n THEN 0 ELSE 1 END AS errors FROM e""",
    "adapter_distribution": f"""SELECT CAST(vec_id AS VARCHAR) AS id, round({_SOFT3[2]} / {_SOFTSUM}, 6) AS en,
  round({_SOFT3[3]} / {_SOFTSUM}, 6) AS de, round({_SOFT3[1]} / {_SOFTSUM}, 6) AS fr, 0 AS errors FROM embeddings""",
    "adapter_allowed_set": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'es' THEN 'unmapped_label'
  WHEN doc_id % 3 = 0 OR lang = 'en' THEN 'allowed_outcome' END AS rule FROM documents""",
    "multilabel_complete": """SELECT CAST(doc_id AS VARCHAR) AS id, qid, CAST(CASE qid WHEN 'quality' THEN quality
  WHEN 'toxic' THEN toxic ELSE 0 END AS DOUBLE) AS p_true, round(1 / 3.0, 6) AS weight
FROM labels CROSS JOIN (VALUES ('quality'), ('toxic'), ('spam')) v(qid)""",
    "multilabel_partial": """SELECT CAST(doc_id AS VARCHAR) AS id, qid, CAST(CASE qid WHEN 'quality' THEN quality
  ELSE toxic END AS DOUBLE) AS p_true, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS weight
FROM labels CROSS JOIN (VALUES ('quality'), ('toxic')) v(qid) WHERE qid = 'quality' OR doc_id % 2 = 0""",
    "label_map_typed": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN quality = 1 THEN 'hi' ELSE 'lo' END AS value,
  CASE WHEN doc_id % 5 = 0 THEN 'label_type' END AS rule FROM labels""",
    "record_digest_ids": """WITH d AS (SELECT CAST(to_json(text) AS VARCHAR) AS j, lang FROM documents)
SELECT 'lang:' || substr(sha256('{"lang":"' || lang || '","text":' || j || '}'), 1, 20) AS id,
  'lang:' || substr(sha256(j), 1, 20) AS split_group, true AS split_group_inferred, lang AS value FROM d""",
    "adapter_native": """SELECT CAST(event_id AS VARCHAR) AS id, 'view|signup|purchase|error|click' AS keys, CAST(event_id % 5 AS DOUBLE) AS weight,
  CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE 2.0 END AS question_weight,
  concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'question_weight' END, CASE WHEN event_id % 5 = 0 THEN 'weight' END) AS rules FROM events""",
    "view_from_state": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS accepted,
  CASE WHEN doc_id % 4 = 0 THEN 'verified' ELSE '' END AS reasons FROM documents""",
    "strict_json": """SELECT event_id, CASE WHEN event_id % 16 IN (1, 2, 4) THEN 0 ELSE 1 END AS strict,
  CASE WHEN event_id % 16 = 3 THEN 0 ELSE 1 END AS finite FROM events""",
    "record_rules": None,
    "quarantine_counts": f"""SELECT CASE WHEN r = '' THEN 'accepted' ELSE r END AS rule, count(*) AS n
FROM (SELECT {_RULES} AS r FROM events) GROUP BY 1""",
    "parsed_questions": """SELECT 'e' || event_id AS id, q.qid, CAST(q.pos AS INTEGER) AS q_pos, q.keys,
  round(1.5 * CASE WHEN q.qid = 'kind' THEN 2 ELSE 1 END / 4, 6) AS weight, 'u' || user_id AS split_group
FROM events CROSS JOIN (VALUES ('kind', 0, 'click|error|purchase|signup|view'), ('level', 1, '0|1|2'), ('sure', 2, 'true|false')) q(qid, pos, keys)
WHERE event_id % 16 = 0""",
    "model_visible": """SELECT 'e' || event_id AS id, '{"state":' || replace(props, ': ', ':') ||
  ',"questions":[{"type":"choice","instructions":"Which?","criteria":{"click":"c","error":null,"purchase":{"a":[1]},"signup":"","view":"v"}},{"type":"score","criteria":["lo","mid","hi"]},{"type":"noul"}]}' AS visible,
  'e' || event_id AS dataset FROM events WHERE event_id % 16 = 0""",
    "request_admission": """SELECT event_id, ['size', 'strict_json', 'object', 'model', 'ok', 'ok'][event_id % 6 + 1] AS admission FROM events""",
    "view_audit": """SELECT vec_id AS vid, CASE vec_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS accepted,
  ['2:object', '0:duplicate_view_id,1:duplicate_view_id,2:object', '1:no_supervised_question,2:object', '1:ordered_outcomes,2:object', '1:verified,2:object', '1:relation,2:object', '1:reference,2:object'][vec_id % 7 + 1] AS reasons FROM embeddings""",
    "validation_report": """SELECT count(*) AS records, CAST(sum(CASE vec_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) AS BIGINT) AS eligible_views,
  CAST(sum(CASE vec_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END) AS BIGINT) AS rejected_views, count(*) AS records_with_rejections FROM embeddings""",
    "nested_requests": """SELECT CAST(i AS INTEGER) AS view_index, ['"s"', '"s1"', '"s2"', NULL][i + 2] AS state, count(*) AS n
FROM embeddings CROSS JOIN range(-1, 3) r(i) GROUP BY 1, 2""",
    "dataset_names": """SELECT CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS dataset, count(*) AS n FROM documents GROUP BY 1""",
}
ORACLE["record_rules"] = f"SELECT event_id, {_RULES} AS rules FROM events"
