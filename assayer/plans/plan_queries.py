"""Leakage, provenance, tokens and update plans."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.operators import leakage as K
from assayer.operators import lineage as N
from assayer.operators import planning as P
from assayer.operators import protect as S
from assayer.operators import records as R
from assayer.operators import tokens as T
from assayer.plans import fixtures as X
from assayer.session import stored

LAYOUT = T.Layout(T.word_tokens, max_sequence=1_500, max_request=1_600)
STEPS, BUDGET = 8, 8192


def _splits(spark, folder, group="text"):
    """Documents with a split from their hash; the group is the text or the source."""
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 10
    split = F.when(h < 7, "train").when(h == 7, "dev").when(h == 8, "calibration").otherwise("test")
    name = F.md5("text") if group == "text" else F.col(group)
    return X.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), split.alias("split"), name.alias("split_group"),
        (F.pmod("doc_id", F.lit(4)) == 0).alias("split_group_inferred"))


def split_leakage(spark, folder):
    return K.split_leakage(_splits(spark, folder))


def duplicate_ids(spark, folder):
    rows = _splits(spark, folder)
    again = rows.filter(F.col("split") == "test")
    return K.duplicate_ids(rows.unionByName(again))


def group_gate(spark, folder):
    rows = _splits(spark, folder).withColumn(
        "split_group", F.when(F.col("split") == "dev", "").otherwise(F.col("split_group")))
    return K.group_gate(rows)


def membership(spark, folder):
    return K.membership(_splits(spark, folder, "source"))


def _sources(spark, folder):
    rows = _splits(spark, folder)
    return K.keys_of(rows, "split").withColumn("path", F.concat(F.lit("data/"), F.col("split")))


def provenance_overlap(spark, folder):
    """Test documents whose text or id was used for another purpose."""
    test = _splits(spark, folder).filter(F.col("split") == "test")
    return K.independence(test, _sources(spark, folder), "evaluation")


def calibration_overlap(spark, folder):
    """The groups of a temperature file exclude evaluation records as well."""
    rows = _splits(spark, folder, "source")
    test = rows.filter(F.col("split") == "test")
    groups = rows.filter((F.col("split") == "calibration") & F.col("split_group").isin("src1", "src2")).select("split_group")
    none = _sources(spark, folder).filter(F.col("split") == "test")
    return K.independence(test, none, "evaluation", groups).select("key_kind", "key", "prior_split").distinct()


def course_conflicts(spark, folder):
    rows = _sources(spark, folder)
    moved = rows.withColumn("split", F.when(F.length("key") % 2 == 0, "train").otherwise(F.col("split")))
    return K.course_conflicts(moved, rows)


def course_merge(spark, folder):
    """Files per (split, sha256): the latest entry wins."""
    rows = X.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("split"), F.md5(F.col("o_custkey").cast("string")).alias("sha256"),
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("path"))
    old, new = rows.filter(F.col("ord") % 2 == 0), rows.filter(F.col("ord") % 2 == 1)
    return K.merge_courses(old, new)


def _runs(spark, folder):
    """A forest of runs with some loops: customer k starts from customer k div 3."""
    k = F.col("c_custkey")
    parent = F.when(k % 101 == 7, k).when(k < 3, F.lit(None)).otherwise(F.floor(k / 3))
    return X.table(spark, folder, "customer").select(
        k.alias("run"), parent.cast("long").alias("parent"), (k % 10 == 4).alias("self_contained"))


def ancestor_closure(spark, folder):
    return K.ancestors(_runs(spark, folder))


def inherited_sources(spark, folder):
    """Runs without training data in their history, and runs whose history is a loop, which may hold some."""
    runs = stored(_runs(spark, folder), "runs")
    sources = runs.select("run", F.when(F.col("run") % 4 == 0, "train").otherwise("dev").alias("split"))
    return N.incomplete_runs(N.interval_labels(runs), runs, sources, "train")


CHAIN = 2000


def _chains(spark, folder):
    """Every order continues from the one before, in chains of 2000; the first of some chains starts from the last one."""
    k = F.col("o_orderkey")
    begin = (k % CHAIN == 0) & (F.floor(k / CHAIN) % 5 != 3)
    parent = F.when(~begin, F.when(k % CHAIN == 0, k + CHAIN - 1).otherwise(k - 1))
    return X.table(spark, folder, "orders").select(k.alias("run"), parent.alias("parent"), F.lit(False).alias("self_contained"), "o_orderstatus")


def lineage_sums(spark, folder):
    """Runs and finished ones in the history of every run, over long chains."""
    runs = stored(_chains(spark, folder), "chains")
    weights = runs.select("run", F.lit(1).cast("long").alias("ancestors"), (F.col("o_orderstatus") == "F").cast("long").alias("finished"))
    labels = N.interval_labels(runs)
    sums = N.ancestor_sums(labels, weights, ["ancestors", "finished"])
    return sums.hint("merge").join(labels.select("run", "cyclic"), "run").join(runs.select("run").hint("merge"), "run")


def lineage_sources(spark, folder):
    """States of all orders in the history of the urgent ones, joined for those only."""
    runs = stored(_chains(spark, folder), "chains")
    urgent = X.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("run"))
    labels = N.interval_labels(runs)
    asked = urgent.hint("merge").join(labels.where("not cyclic"), "run", "left_semi")
    return N.inherited_sources(asked, labels, runs.select("run", F.col("o_orderstatus").alias("state")))


def view_set_join(spark, folder):
    """Records with views from a second set; unmatched view records are added once."""
    docs = X.table(spark, folder, "documents")
    left = docs.filter("doc_id % 3 < 2").select(F.col("doc_id").alias("id"), "lang", F.lit("own").alias("views"))
    right = docs.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), "lang", F.lit("paired").alias("views"))
    return K.attach_views(left, right)


def view_set_problems(spark, folder):
    docs = X.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("eligible"))
    return K.view_set_problems(docs.unionByName(docs.filter("id % 7 = 0")))


def pair_differences(spark, folder):
    """Copies that differ beyond views, token columns and the training-use note."""
    j = lambda views, note, order: F.concat(
        F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('","lang":"'),
        F.when(F.lit(order) & (F.col("doc_id") % 6 == 0), "xx").otherwise(F.col("lang")),
        F.lit(f'","metadata":{{"training_use":"{note}","a":1}},"views":{views}}}'))
    docs = X.table(spark, folder, "documents").withColumn("id", F.col("doc_id"))
    return K.pair_differences(docs.select("id", j("[]", "a", False).alias("record_json")),
                              docs.select("id", j("[1]", "b", True).alias("record_json")))


def set_operations(spark, folder):
    """Groups of two splits: both, only one, all."""
    rows = _splits(spark, folder)
    a = rows.filter("split = 'train'").select("split_group").distinct()
    b = rows.filter("split = 'test'").select("split_group").distinct()
    size = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return size("both", a.intersect(b)).unionByName(size("train_only", a.subtract(b))).unionByName(
        size("all", a.union(b).distinct()))


def _questions(spark, folder):
    """One question per part: a small set of templates repeated over the table."""
    keys = F.slice(X.names(["red", "green", "blue", "none"]), F.lit(1), F.pmod("p_size", F.lit(3)).cast("int") + 2)
    q = R.question(F.lit("q"), F.lit("choice"), keys, F.transform(keys, lambda k: F.concat(F.lit('"is '), k, F.lit('"'))),
                   F.concat(F.lit('"Pick for '), F.col("p_type"), F.lit(' <unused0>"')))
    return X.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_type", q.alias("question"))


def question_layout(spark, folder):
    """Token layout of each distinct question, joined back to all rows that use it."""
    rows = _questions(spark, folder).withColumn("text", R.question_json(F.col("question")))
    out = T.compile_distinct(rows, LAYOUT, "text", F.col("id"), rows_per_task=100)
    return out.select(
        "id", F.size("tokens").alias("tokens"), "decision_position", "instruction_tokens",
        F.array_join(F.transform("candidate_starts", lambda x: x.cast("string")), ",").alias("starts"),
        F.array_join(F.transform("candidate_positions", lambda x: x.cast("string")), ",").alias("positions"),
        T.marker_forgeries(F.col("tokens"), T.CANDIDATE_END, F.col("candidate_positions")).cast("int").alias("forged"))


def stored_layout_rules(spark, folder):
    """Damaged stored layouts: a lost option, a moved decision, a moved option position."""
    rows = _questions(spark, folder)
    out = T.question_layout(rows, LAYOUT)
    k = F.col("id") % 4
    out = out.select(
        "id", "tokens", F.lit(5).alias("state_tokens"),
        F.when(k == 1, F.slice("question.keys", 1, 1)).otherwise(F.col("question.keys")).alias("keys"),
        F.when(k == 2, F.col("decision_position") - 1).otherwise(F.col("decision_position")).alias("decision_position"),
        F.when(k == 3, F.transform("candidate_positions", lambda p: p - 1)).otherwise(F.col("candidate_positions"))
        .alias("candidate_positions"))
    return out.select("id", F.coalesce(T.stored_violations(out, LAYOUT), F.lit("ok")).alias("rule"))


def option_reordering(spark, folder):
    """Stored chunks in reverse order equal a fresh layout of the reversed question, for each distinct question, joined back to all rows that use it."""
    rows = _questions(spark, folder).withColumn("text", F.to_json("question"))
    back = F.reverse("question.keys")

    def compared(distinct):
        moved = T.question_layout(distinct, LAYOUT).withColumn("moved", T.reorder_options(
            F.col("tokens"), F.col("question.keys"), F.col("candidate_starts"), F.col("candidate_positions"), F.col("decision_position"), back))
        turned = distinct.select("question_sha", F.col("question").withField("keys", back).alias("question"))
        fresh = T.question_layout(turned, LAYOUT).select("question_sha", F.col("tokens").alias("t2"), F.col("candidate_positions").alias("p2"))
        return moved.join(fresh, "question_sha").select("question_sha", "n", "question", (F.col("moved.tokens") == F.col("t2")).cast("int").alias("same_tokens"),
                                                        (F.col("moved.candidate_positions") == F.col("p2")).cast("int").alias("same_positions"))

    return T.per_distinct(rows, compared, "text", F.col("id")).select("id", "same_tokens", "same_positions")


def neutralized_markers(spark, folder):
    """Texts with literal marker spellings: each becomes nine byte tokens and no marker id is left."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" <unused0> x <unused1>"))).otherwise(F.col("text"))
    tokens = T.word_tokens(text)
    rows = X.table(spark, folder, "documents").select("doc_id", F.col("text").alias("raw"), tokens.alias("tokens"))
    return rows.select(
        "doc_id", (F.size("tokens") - F.size(T.words_of(F.col("raw")))).alias("added"),
        F.size(F.filter("tokens", lambda t: t.isin(T.CANDIDATE_END, T.DECISION_END))).alias("markers"))


GUARDED = {"<unused0>": 50_000, "<unused1>": 50_001, "<unused0><unused1>": 50_002}


def _outside_tokens(text):
    """Tokens of a stand-in for an outside tokenizer, with their places: marker spellings have the markers' ids, longest first."""

    def run(texts: pa.Array) -> pa.Array:
        piece = re.compile("|".join(re.escape(x) for x in sorted(GUARDED, key=len, reverse=True)) + r"|\w+|[^\w\s]")
        size, flat = [0], array("i")  # plain numbers: a batch holds millions of tokens
        for t in texts:
            for m in piece.finditer(t.as_py() or ""):
                flat.extend((GUARDED.get(m[0], 300 + len(m[0]) % 100), m.start(), m.end()))
            size.append(len(flat) // 3)
        parts = np.frombuffer(flat, dtype=np.int32).reshape(-1, 3)
        return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], ["id", "start", "stop"]))

    return F.arrow_udf(run, "array<struct<id:int,start:int,stop:int>>")(text)


def protected_spans(spark, folder):
    """Documents with forged markers, some side by side: places of the spellings, and the ids after they became bytes."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("<unused0> "), "text")).when(k == 1, F.concat("text", F.lit("é<unused0><unused1><unused1>"))).otherwise(F.col("text"))
    rows = X.table(spark, folder, "documents").select("doc_id", text.alias("text"))
    rows = rows.withColumns({"tokens": _outside_tokens(F.col("text")), "spans": S.protected_spans(F.col("text"), GUARDED)})
    safe = rows.withColumn("ids", S.neutralized(F.col("tokens"), F.col("text"), GUARDED))
    return safe.select(
        "doc_id", F.size("spans").alias("spans"), F.coalesce(F.get("spans", F.lit(0))["start"], F.lit(-1)).alias("first"),
        (F.size("ids") - F.size("tokens")).alias("added"), F.size(F.filter("ids", lambda i: i >= 50_000)).alias("left"),
        F.size(F.filter("ids", lambda i: i < 256)).alias("bytes"))


def encoder_preface(spark, folder):
    """Distinct instructions of a conversation's questions; dropped where the budget is short."""
    turns = X.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.sum(F.length("text")).alias("n"))
    rows = turns.select(
        "conv_id", T.preface(F.transform("t", lambda x: F.concat(F.lit("About "), x["role"]))).alias("preface"),
        F.concat(F.lit('"'), F.repeat(F.lit("w "), F.col("n").cast("int")), F.lit('"')).alias("state_json"),
        F.lit(20).alias("longest"), F.lit(60).alias("asked"))
    out = T.state_tokens(rows, LAYOUT, longest="longest", asked="asked", with_preface="preface")
    return out.select("conv_id", "preface", "state_tokens", F.col("has_preface").cast("int").alias("has_preface"))


def _token_rows(spark, folder):
    return X.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.size(T.word_tokens(F.col("text"))).alias("state_tokens"),
        F.explode(F.array(F.lit(12), F.lit(7))).alias("question_tokens"))


def budget_reject(spark, folder):
    return T.budget_violations(_token_rows(spark, folder), LAYOUT)


def token_costs(spark, folder):
    """Costs of a record with up to two views: the first shares the state, the second may fail."""
    docs = X.table(spark, folder, "documents")
    s = F.ceil(F.col("n_chars") / 4)
    base = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("state_sha"), s.alias("state_tokens"),
                       (s + 12).alias("input_tokens"))
    i = F.col("view_index")
    views = docs.withColumn("view_index", F.explode(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (F.col("doc_id") % 3).cast("int")))).select(
        F.col("doc_id").alias("id"), "view_index", F.when(i == 0, F.md5("text")).otherwise(F.md5("lang")).alias("state_sha"),
        (s + i).alias("state_tokens"), F.when((i == 1) & (F.col("doc_id") % 2 == 0), F.lit(None)).otherwise(s + i + 9).alias("input_tokens"))
    return T.pair_costs(base, views)


def token_cost_rows(spark, folder):
    return token_costs(spark, folder).select("id", F.array_join(F.transform("costs", lambda c: c.cast("string")), ",").alias("costs"))


def tokenization_report(spark, folder):
    return T.tokenization_report(token_costs(spark, folder))


def _costs(spark, folder):
    return X.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), (F.ceil(F.col("n_chars") / 4) + 12).alias("cost"), "n_chars")


def epoch_shuffle(spark, folder):
    return P.epoch_order(_costs(spark, folder), 17, 2).select("epoch", "ord", "id")


def _plan(spark, folder, epochs=2, **options):
    ordered = P.epoch_order(_costs(spark, folder), 17, epochs)
    return P.plan_updates(ordered, STEPS, BUDGET, **options)


def update_plan(spark, folder):
    """Small blocks, so that many hand-overs between blocks take part."""
    return _plan(spark, folder, block_rows=256, blocks_per_group=2)


def update_plan_capped(spark, folder):
    return _plan(spark, folder, max_steps=20).groupBy("epoch", "update").agg(
        F.count(F.lit(1)).alias("records"), F.sum("cost").alias("tokens"))


def physical_packs(spark, folder):
    return P.physical_packs(_plan(spark, folder, 1), 3, 2500).select("update", "pos", "id", "pack")


def pack_offsets(spark, folder):
    packs = P.physical_packs(_plan(spark, folder, 1), 3, 2500)
    return P.pack_offsets(packs).select("id", "pack", "offset")


def _dims(spark, folder):
    return _plan(spark, folder, 1).withColumns({
        "enc": F.col("cost"), "dec": F.pmod("id", F.lit(40)) + 5, "states": F.lit(1).cast("long"),
        "questions": F.pmod("id", F.lit(3)) + 1})


def length_buckets(spark, folder):
    return P.length_buckets(_dims(spark, folder), 4, 6000).groupBy("update", "batch").agg(
        F.count(F.lit(1)).alias("records"), F.max("enc").alias("enc"), F.min("enc").alias("low"))


def rank_assignment(spark, folder):
    return P.assign_ranks(_plan(spark, folder, 1), 3).groupBy("update", "rank").agg(
        F.sum("cost").alias("load"), F.count(F.lit(1)).alias("records"))


def question_batches(spark, folder):
    rows = X.table(spark, folder, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("q_pos")).agg(
        F.max("l_quantity").cast("int").alias("length"))
    rows = rows.select(F.col("l_orderkey").alias("id"), "q_pos", "length", F.col("q_pos").cast("string").alias("qid"))
    return P.question_batches(rows, 3).select("id", "length", "batch", F.col("pos_in_order").alias("pos"))


def view_sample(spark, folder):
    views = X.table(spark, folder, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").cast("string").alias("view_id"))
    return P.sample_view(views, 5, 1)


def update_statistics(spark, folder):
    plan = P.assign_ranks(_plan(spark, folder, 1), 2).withColumn("seconds", F.col("rank") + 1.5)
    return P.update_statistics(plan, ["cost"], ["cost"], "seconds").select(
        "update", "cost", "max_cost", "records", F.round("cost_per_second", 6).alias("cost_per_second"))


QUERIES = {
    f.__name__: f
    for f in (
        split_leakage, duplicate_ids, group_gate, membership, provenance_overlap,
        calibration_overlap, course_conflicts, course_merge, ancestor_closure, inherited_sources, lineage_sums, lineage_sources,
        view_set_join, view_set_problems, pair_differences, set_operations, question_layout,
        stored_layout_rules, option_reordering, neutralized_markers, protected_spans, encoder_preface,
        budget_reject, token_cost_rows, tokenization_report, epoch_shuffle, update_plan,
        update_plan_capped, physical_packs, pack_offsets, length_buckets, rank_assignment,
        question_batches, view_sample, update_statistics,
    )
}

_SPLIT = """s AS (SELECT CAST(doc_id AS VARCHAR) AS id, {group} AS g, doc_id,
  CASE WHEN h < 7 THEN 'train' WHEN h = 7 THEN 'dev' WHEN h = 8 THEN 'calibration' ELSE 'test' END AS split
  FROM (SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER) % 10 AS h FROM documents))"""
_S = _SPLIT.format(group="md5(text)")
_KEYS = "k AS (SELECT 'split_group' AS key_kind, g AS key, split FROM s UNION ALL SELECT 'record_id', id, split FROM s)"

_ORDER = """o AS (SELECT e AS epoch, doc_id AS id, CAST(ceil(n_chars / 4.0) AS BIGINT) + 12 AS cost,
  row_number() OVER (PARTITION BY e ORDER BY substr(md5('17:' || e || ':' || doc_id), 1, 15), doc_id) - 1 AS ord
  FROM documents CROSS JOIN range(0, {epochs}) r(e))"""


def _plan_sql(epochs: int) -> str:
    return f"""RECURSIVE {_ORDER.format(epochs=epochs)},
w AS (SELECT epoch, ord, id, cost, 0 AS u, 0 AS pos, cost AS used FROM o WHERE ord = 0
  UNION ALL
  SELECT o.epoch, o.ord, o.id, o.cost, CASE WHEN w.pos + 1 = {STEPS} OR w.used + o.cost > {BUDGET} THEN w.u + 1 ELSE w.u END,
    CASE WHEN w.pos + 1 = {STEPS} OR w.used + o.cost > {BUDGET} THEN 0 ELSE w.pos + 1 END,
    CASE WHEN w.pos + 1 = {STEPS} OR w.used + o.cost > {BUDGET} THEN o.cost ELSE w.used + o.cost END
  FROM w JOIN o ON o.epoch = w.epoch AND o.ord = w.ord + 1),
n AS (SELECT epoch, max(u) + 1 AS c FROM w GROUP BY epoch),
p AS (SELECT epoch, ord, id, cost, pos, CAST(u + coalesce((SELECT sum(c) FROM n WHERE n.epoch < w.epoch), 0) AS BIGINT) AS update FROM w)"""


_PACK = """pk AS (SELECT update, pos, id, cost, 0 AS pack, 1 AS cnt, cost AS used FROM p WHERE pos = 0
  UNION ALL SELECT p.update, p.pos, p.id, p.cost, CASE WHEN k.cnt >= 3 OR k.used + p.cost > 2500 THEN k.pack + 1 ELSE k.pack END,
    CASE WHEN k.cnt >= 3 OR k.used + p.cost > 2500 THEN 1 ELSE k.cnt + 1 END,
    CASE WHEN k.cnt >= 3 OR k.used + p.cost > 2500 THEN p.cost ELSE k.used + p.cost END
  FROM pk k JOIN p ON p.update = k.update AND p.pos = k.pos + 1)"""
_RANK2 = """rk AS (SELECT update, id, cost, row_number() OVER (PARTITION BY update ORDER BY cost DESC, pos) - 1 AS i FROM p),
a AS (SELECT update, i, cost, 0 AS rank, [cost{zeros}] AS loads FROM rk WHERE i = 0
  UNION ALL SELECT rk.update, rk.i, rk.cost, list_position(a.loads, list_min(a.loads)) - 1,
    {loads} FROM a JOIN rk ON rk.update = a.update AND rk.i = a.i + 1)"""


def _ranks(world: int) -> str:
    loads = "[" + ", ".join(
        f"a.loads[{i + 1}] + CASE WHEN list_position(a.loads, list_min(a.loads)) = {i + 1} THEN rk.cost ELSE 0 END"
        for i in range(world)) + "]"
    return _RANK2.format(zeros=", 0" * (world - 1), loads=loads)


_BUCKET = """b0 AS (SELECT update, pos, id, cost AS enc, id % 40 + 5 AS dec, id % 3 + 1 AS nq,
  row_number() OVER (PARTITION BY update ORDER BY length(bin(cost)), length(bin(id % 40 + 5)), pos) - 1 AS i FROM p),
bk AS (SELECT update, i, enc, 0 AS batch, 1 AS cnt, enc AS emax, enc AS emin, dec AS dmax, dec AS dmin, 1 AS ns, nq FROM b0 WHERE i = 0
  UNION ALL SELECT x.update, x.i, x.enc, CASE WHEN o THEN k.batch + 1 ELSE k.batch END, CASE WHEN o THEN 1 ELSE k.cnt + 1 END,
    CASE WHEN o THEN x.enc ELSE greatest(k.emax, x.enc) END, CASE WHEN o THEN x.enc ELSE least(k.emin, x.enc) END,
    CASE WHEN o THEN x.dec ELSE greatest(k.dmax, x.dec) END, CASE WHEN o THEN x.dec ELSE least(k.dmin, x.dec) END,
    CASE WHEN o THEN 1 ELSE k.ns + 1 END, CASE WHEN o THEN x.nq ELSE k.nq + x.nq END
  FROM bk k JOIN b0 x ON x.update = k.update AND x.i = k.i + 1 CROSS JOIN LATERAL (SELECT k.cnt >= 4
    OR greatest(k.emax, x.enc) > 2 * least(k.emin, x.enc) OR greatest(k.dmax, x.dec) > 2 * least(k.dmin, x.dec)
    OR greatest(k.emax, x.enc) * (k.ns + 1) + greatest(k.dmax, x.dec) * (k.nq + x.nq) > 6000 AS o) z)"""

_WORDS = "len(regexp_extract_all({}, '<unused[01]>|[A-Za-z0-9\\x{{00C0}}-\\x{{024F}}]+|[^ \\t\\r\\nA-Za-z0-9\\x{{00C0}}-\\x{{024F}}]'))"


def _words(expr: str) -> str:
    return _WORDS.format(expr)


_RUNS = """r AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 10 = 4 THEN NULL WHEN c_custkey % 101 = 7 THEN c_custkey
  WHEN c_custkey < 3 THEN NULL ELSE c_custkey // 3 END AS parent FROM customer),
c AS (SELECT run, run AS ancestor, 0 AS depth FROM r
  UNION ALL SELECT c.run, r.parent, c.depth + 1 FROM c JOIN r ON r.run = c.ancestor WHERE r.parent IS NOT NULL AND c.depth < 30),
f AS (SELECT run, ancestor, min(depth) AS depth, max(depth) >= 30 AS deep FROM c WHERE ancestor IS NOT NULL GROUP BY 1, 2),
g AS (SELECT run, bool_or(deep) AS cyclic FROM f GROUP BY run)"""

_CHAINS = f"""chains AS (SELECT o_orderkey AS run, o_orderkey // {CHAIN} AS chain, o_orderstatus AS state, o_orderpriority = '1-URGENT' AS urgent,
  (o_orderkey // {CHAIN}) % 5 = 3 AND (o_orderkey // {CHAIN} + 1) * {CHAIN} - 1 IN (SELECT o_orderkey FROM orders) AS cyclic FROM orders)"""

ORACLE = {
    "split_leakage": f"""WITH {_S}, {_KEYS} SELECT key_kind, key, min(split) AS first_split, max(split) AS last_split, count(*) AS n
FROM k GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
    "duplicate_ids": f"WITH {_S} SELECT id, 2 AS n FROM s WHERE split = 'test'",
    "group_gate": f"""WITH {_S} SELECT id, CASE WHEN split = 'dev' THEN 'missing' ELSE 'inferred' END AS reason
FROM s WHERE split = 'dev' OR doc_id % 4 = 0""",
    "membership": "SELECT 'split_group' AS key_kind, source AS key FROM documents GROUP BY 2 UNION ALL SELECT 'record_id', CAST(doc_id AS VARCHAR) FROM documents",
    "provenance_overlap": f"""WITH {_S}, {_KEYS} SELECT a.key_kind, a.key, min(b.split) AS prior_split, 'data/' || min(b.split) AS path
FROM (SELECT DISTINCT key_kind, key FROM k WHERE split = 'test') a JOIN k b ON a.key_kind = b.key_kind AND a.key = b.key AND b.split <> 'test' GROUP BY 1, 2""",
    "calibration_overlap": f"""WITH {_SPLIT.format(group='source')} SELECT DISTINCT 'split_group' AS key_kind, g AS key, 'calibration' AS prior_split
FROM s WHERE split = 'test' AND g IN ('src1', 'src2') AND g IN (SELECT g FROM s WHERE split = 'calibration')""",
    "course_conflicts": f"""WITH {_S}, {_KEYS}, m AS (SELECT DISTINCT key_kind, key, CASE WHEN length(key) % 2 = 0 THEN 'train' ELSE split END AS split FROM k)
SELECT m.key_kind, m.key, m.split, o.split AS prior_split FROM m JOIN (SELECT DISTINCT * FROM k) o ON m.key_kind = o.key_kind AND m.key = o.key WHERE m.split <> o.split""",
    "course_merge": """SELECT o_orderstatus AS split, md5(CAST(o_custkey AS VARCHAR)) AS sha256, max(o_orderkey) AS ord,
  arg_max(o_orderpriority, o_orderkey) AS path FROM orders GROUP BY 1, 2""",
    "ancestor_closure": f"WITH RECURSIVE {_RUNS} SELECT f.run, ancestor, depth, cyclic FROM f JOIN g ON f.run = g.run",
    "inherited_sources": f"""WITH RECURSIVE {_RUNS},
h AS (SELECT run, g.cyclic, sum(CASE WHEN ancestor % 4 = 0 AND ancestor IN (SELECT run FROM r) THEN 1 ELSE 0 END) > 0 AS sourced FROM f JOIN g USING (run) GROUP BY run, g.cyclic)
SELECT run, cyclic, sourced FROM h WHERE cyclic OR NOT sourced""",
    "lineage_sums": f"""WITH {_CHAINS} SELECT run, CASE WHEN NOT cyclic THEN count(*) OVER w END AS ancestors,
  CASE WHEN NOT cyclic THEN CAST(count(*) FILTER (WHERE state = 'F') OVER w AS BIGINT) END AS finished, cyclic FROM chains WINDOW w AS (PARTITION BY chain ORDER BY run)""",
    "lineage_sources": f"""WITH {_CHAINS}, seen AS (SELECT chain, state, min(run) AS first FROM chains GROUP BY 1, 2)
SELECT run, s.state FROM chains c JOIN seen s ON s.chain = c.chain AND s.first <= c.run WHERE NOT c.cyclic AND c.urgent""",
    "view_set_join": "SELECT doc_id AS id, lang, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'paired' END AS views FROM documents",
    "view_set_problems": "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'duplicate' ELSE 'no_view' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0",
    "pair_differences": "SELECT doc_id AS id FROM documents WHERE doc_id % 6 = 0",
    "set_operations": f"""WITH {_S}, a AS (SELECT DISTINCT g FROM s WHERE split = 'train'), b AS (SELECT DISTINCT g FROM s WHERE split = 'test')
SELECT 'both' AS part, (SELECT count(*) FROM a JOIN b USING (g)) AS n UNION ALL
SELECT 'train_only', (SELECT count(*) FROM a WHERE g NOT IN (SELECT g FROM b)) UNION ALL
SELECT 'all', (SELECT count(*) FROM (SELECT g FROM a UNION SELECT g FROM b))""",
    "question_layout": f"""WITH q AS (SELECT p_partkey AS id, p_size % 3 + 2 AS n, {_words("'" + '"Pick for ' + "' || p_type || ' " + '"' + "'")} + 9 AS ins FROM part),
h AS (SELECT id, n, ins, 1 + 3 + 2 + ins AS head FROM q)
SELECT id, CAST(head + n * 21 + 1 AS INTEGER) AS tokens, CAST(head + n * 21 AS INTEGER) AS decision_position, CAST(ins AS INTEGER) AS instruction_tokens,
  array_to_string([head + 21 * i for i in range(0, n)], ',') AS starts,
  array_to_string([head + 21 * i + 20 for i in range(0, n)], ',') AS positions, 0 AS forged FROM h""",
    "stored_layout_rules": "SELECT p_partkey AS id, ['ok', 'count', 'decision', 'candidates'][p_partkey % 4 + 1] AS rule FROM part",
    "option_reordering": "SELECT p_partkey AS id, 1 AS same_tokens, 1 AS same_positions FROM part",
    "neutralized_markers": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 19 ELSE 0 END AS added, 0 AS markers FROM documents",
    "protected_spans": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END AS spans, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN length(text) + 1 ELSE -1 END AS first,
  CASE doc_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 25 ELSE 0 END AS added, 0 AS left, CASE doc_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 27 ELSE 0 END AS bytes FROM documents""",
    "encoder_preface": f"""WITH t AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2),
c AS (SELECT conv_id, CAST(to_json(list('About ' || role ORDER BY f)) AS VARCHAR) AS j FROM t GROUP BY 1),
n AS (SELECT conv_id, sum(length(text)) + 4 AS body FROM conversations GROUP BY 1),
a AS (SELECT conv_id, chr(10) || chr(10) || 'questions: ' || j AS preface, body FROM c JOIN n USING (conv_id)),
b AS (SELECT *, body + {_words('preface')} AS aware FROM a)
SELECT conv_id, preface, CAST(CASE WHEN aware + 20 <= 1500 AND aware + 60 <= 1600 THEN aware ELSE body END AS INTEGER) AS state_tokens,
  CASE WHEN aware + 20 <= 1500 AND aware + 60 <= 1600 THEN 1 ELSE 0 END AS has_preface FROM b""",
    "budget_reject": f"""WITH t AS (SELECT doc_id AS id, {_words('text')} AS n FROM documents)
SELECT id, CASE WHEN n + 12 > 1500 THEN 'sequence' ELSE 'request' END AS budget FROM t WHERE n + 12 > 1500 OR n + 19 > 1600""",
    "token_cost_rows": """WITH d AS (SELECT doc_id AS id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS s FROM documents)
SELECT id, (s + 12) || CASE WHEN id % 3 > 0 THEN ',' || (s + 21) ELSE '' END ||
  CASE WHEN id % 3 > 1 THEN ',' || CASE WHEN id % 2 = 0 THEN s + 12 ELSE 2 * s + 22 END ELSE '' END AS costs FROM d""",
    "tokenization_report": """SELECT count(*) AS records, CAST(sum(ceil(n_chars / 4.0) + 12) AS BIGINT) AS base_tokens,
  CAST(sum(CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS records_with_views FROM documents""",
    "epoch_shuffle": f"WITH {_ORDER.format(epochs=2)} SELECT epoch, ord, id FROM o",
    "update_plan": f"WITH {_plan_sql(2)} SELECT epoch, ord, id, cost, update, pos FROM p",
    "update_plan_capped": f"WITH {_plan_sql(2)} SELECT epoch, update, count(*) AS records, CAST(sum(cost) AS BIGINT) AS tokens FROM p WHERE update < 20 GROUP BY 1, 2",
    "physical_packs": f"WITH {_plan_sql(1)}, {_PACK} SELECT update, pos, id, pack FROM pk",
    "pack_offsets": f"WITH {_plan_sql(1)}, {_PACK} SELECT id, pack, CAST(sum(cost) OVER (PARTITION BY update, pack ORDER BY pos) - cost AS BIGINT) AS \"offset\" FROM pk",
    "length_buckets": f"WITH {_plan_sql(1)}, {_BUCKET} SELECT update, batch, count(*) AS records, max(enc) AS enc, min(enc) AS low FROM bk GROUP BY 1, 2",
    "rank_assignment": f"WITH {_plan_sql(1)}, {_ranks(3)} SELECT update, rank, CAST(sum(cost) AS BIGINT) AS load, count(*) AS records FROM a GROUP BY 1, 2",
    "question_batches": """WITH RECURSIVE l AS (SELECT l_orderkey AS id, l_linenumber AS qp, CAST(floor(max(l_quantity)) AS INTEGER) AS length FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length, qp) - 1 AS pos FROM l),
b AS (SELECT id, pos, length, 0 AS batch, 1 AS cnt, length AS f FROM i WHERE pos = 0
  UNION ALL SELECT i.id, i.pos, i.length, CASE WHEN b.cnt = 3 OR i.length > 2 * b.f THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.cnt = 3 OR i.length > 2 * b.f THEN 1 ELSE b.cnt + 1 END, CASE WHEN b.cnt = 3 OR i.length > 2 * b.f THEN i.length ELSE b.f END
  FROM b JOIN i ON i.id = b.id AND i.pos = b.pos + 1)
SELECT id, length, batch, pos FROM b""",
    "view_sample": """SELECT user_id AS id, arg_min(CAST(event_id AS VARCHAR), md5('5:1:' || user_id || ':' || event_id)) AS view_id FROM events GROUP BY 1""",
    "update_statistics": f"""WITH {_plan_sql(1)}, {_ranks(2)} SELECT update, CAST(sum(cost) AS BIGINT) AS cost, max(cost) AS max_cost, count(*) AS records,
  round(sum(cost) / (max(rank) + 1.5), 6) AS cost_per_second FROM a GROUP BY 1""",
}
