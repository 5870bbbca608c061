"""Sources, packed images, digests, run logs, representations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import adapters as A
from assayer.operators import leakage
from assayer.operators import records as R
from assayer.operators import representation as G
from assayer.operators import runs as L
from assayer.operators import tokens as T
from assayer.plans import fixtures as X
from assayer.plans.metric_queries import _rounded
from assayer.plans.record_queries import DAMAGE, _record_texts
from assayer.plans.sql import r6
from assayer.session import fresh_path, spread, stored
from assayer.sources import canonical as C
from assayer.sources import packed as K
from assayer.sources import rows as S
from assayer.streaming import jobs as J
from assayer.streaming.reuse import reuse_states


def jsonl_source(spark, folder):
    path = fresh_path(spark, "jsonl")
    texts = _record_texts(spark, folder)
    blank = F.when(F.col("event_id") % 50 == 0, F.array("value", F.lit("  "))).otherwise(F.array("value"))
    texts.select(F.explode(blank).alias("value")).write.text(path)
    rows = S.read_jsonl(spark, path)
    return rows.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def json_array_source(spark, folder):
    """One file per region, each an array of its nations."""
    path = fresh_path(spark, "array")
    rows = X.table(spark, folder, "nation").groupBy("n_regionkey").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    rows.write.partitionBy("n_regionkey").text(path)
    out = S.read_json_array(spark, f"{path}/*/*.txt")
    return out.select("position", F.get_json_object("value", "$.n_name").alias("name"),
                      F.get_json_object("value", "$.n_nationkey").alias("key"))


def csv_source(spark, folder):
    """All values stay strings, quotes and separators included."""
    path = fresh_path(spark, "csv")
    rows = X.table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit('a "q", '), F.col("c_name")).alias("c_name"), "c_mktsegment")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return S.read_delimited(spark, path).select("c_custkey", "c_name", "c_mktsegment")


def benchmark_cases(spark, folder):
    """Gold distributions from JSON, in the key order of the document."""
    cases = X.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit('"s"').alias("state"), F.lit("{}").alias("questions"),
        F.concat(F.lit('{"q":{"type":"choice","label":"'), F.when(F.col("label") < 5, "no").otherwise("yes"),
                 F.lit('","probabilities":{"yes":0.'), F.col("label").cast("string"), F.lit(',"no":0.5}}}')).alias("gold"))
    return S.gold_rows(cases).select("id", "qid", "type", "label", F.array_join("keys", ",").alias("keys"),
                                     F.get("g", F.lit(0)).alias("first"))


PNG = "89504E470D0A1A0A"
TEXT = "00000004" + "74455874" + "6163544C" + "00000000"  # a text chunk that holds "acTL"
CONTROL = "00000008" + "6163544C"  # the head of an animation chunk


def _image_records(spark, folder):
    """Documents as records with zero, one or two images whose bytes follow from the text."""
    rows = X.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("split_group"),
        F.concat(F.lit('{"dataset":"'), F.col("lang"), F.lit('"}')).alias("metadata"))
    config = {"adapter": "classification", "fields": {"label": "lang"},
              "question": {"type": "choice", "criteria": {k: None for k in ("en", "de", "fr", "es")}}}
    out = A.normalize(rows, config, "img")
    body = lambda n: F.concat(F.lit("data:image/png;base64,"), F.base64(F.unhex(F.concat(
        F.lit(PNG), F.md5(F.concat("id", F.lit(n)))))))
    images = F.slice(F.array(body("a"), body("b")), F.lit(1), (F.col("id").cast("int") % 3))
    return out.withColumn("request", F.col("request").withField(
        "images", F.when(F.size(images) > 0, images)))


def packed_roundtrip(spark, folder):
    """Pack, write, read and unpack: every record text comes back unchanged."""
    path = fresh_path(spark, "packed")
    records = _image_records(spark, folder)
    K.write_packed(K.pack(records).filter(F.col("problem").isNull()), path)
    sent = spread(K.read_packed(spark, path), X.ROWS_PER_TASK)  # a file per data set would be read by as many tasks
    back = K.unpack(K.packed_problem(sent).filter(F.col("problem").isNull()))
    both = back.join(records.select("id", R.record_json(records).alias("sent")), "id")
    return both.select("id", F.size("images").alias("images"), (F.col("value") == F.col("sent")).cast("int").alias("same"), "dataset")


def packed_integrity(spark, folder):
    """Damaged packed rows: wrong identity, lost image, empty image, unused image."""
    rows = K.pack(_image_records(spark, folder)).drop("problem")
    k = F.col("id").cast("int") % 5
    extra = F.array(F.struct(F.unhex(F.lit(PNG)).alias("bytes"), F.lit(None).cast("string").alias("path")))
    damaged = rows.select(
        F.when(k == 1, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), F.col("id").alias("doc"),
        "schema_version", "record_json",
        F.when(k == 2, F.filter("images", lambda i: F.lit(False)))
        .when(k == 3, F.transform("images", lambda i: i.withField("bytes", F.lit(b""))))
        .when(k == 4, F.concat("images", extra)).otherwise(F.col("images")).alias("images"))
    return K.packed_problem(damaged).select("doc", F.coalesce("problem", F.lit("ok")).alias("problem"))


def image_audit(spark, folder):
    """Declared type against content, animations and empty payloads."""
    k = F.col("doc_id") % 6
    head = (F.when(k == 0, PNG).when(k == 1, "FFD8FFE0").when(k == 2, "52494646AABBCCDD57454250")
            .when(k == 3, "FFD8FFE0").when(k == 4, PNG + TEXT + CONTROL).otherwise(""))
    # the letters acTL inside a text chunk are no animation, a chunk of that name is
    head = F.when((k == 0) & (F.length("text") % 2 == 0), PNG + TEXT).otherwise(head)
    content = F.unhex(F.when(k == 5, "").otherwise(F.concat(head, F.md5("text"))))
    mime = (F.when(k == 1, "image/jpeg").when(k == 2, "image/webp").otherwise("image/png"))
    return X.table(spark, folder, "documents").select(
        "doc_id", F.coalesce(K.image_problem(mime, content), F.lit("ok")).alias("problem"))


def _token_tables(spark, folder):
    rows = X.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "n_chars", "text")
    costs = F.size(T.word_tokens(F.coalesce("text", F.lit(""))))
    tokens = rows.select("id", F.lit("{}").alias("_tokenized"), F.array(costs).alias("_token_costs"),
                         F.col("lang").alias("_split_group"), F.lit(False).alias("_group_inferred"))
    return rows.drop("text"), tokens


def token_publish(spark, folder):
    """Token columns beside the rows, published as a version after the row count matched."""
    path = fresh_path(spark, "tokens")
    rows, tokens = _token_tables(spark, folder)
    settings = {"tokenizer": "words", "version": 1}
    K.publish_tokens(spark, rows, tokens, path, settings)
    K.publish_tokens(spark, K.read_tokens(spark, path, settings), tokens, path, settings)
    out = K.read_tokens(spark, path, settings, check=True)
    return out.groupBy("_split_group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("_token_costs", F.lit(0))).alias("tokens"))


def token_snapshots(spark, folder):
    """Two writers after one version: the first commits, the second conflicts and takes the next one. Rows, tokens and costs of every version, and what the missing check finds."""
    path = fresh_path(spark, "snapshots")
    rows, tokens = _token_tables(spark, folder)
    settings = {"tokenizer": "words", "version": 1}
    K.publish_tokens(spark, rows, tokens, path, settings, after=None)
    later = rows.where(F.col("id").cast("long") % 2 == 0)
    try:
        K.publish_tokens(spark, later, tokens, path, settings, after=None)
        won = 1
    except K.versions.Conflict:
        won = 0
        K.publish_tokens(spark, later, tokens, path, settings)
    missing = T.tokens_missing(K.read_tokens(spark, path, settings, check=True)).select(F.col("missing").alias("untokenized"))
    state = "struct<rows:long,tokens:long,least:long,costs:long>"
    facts = K.versions.snapshots(spark, path).select("version", "parent", F.from_json("state", state).alias("s"))
    return facts.select("version", "parent", "s.rows", "s.tokens", "s.costs", F.lit(won).alias("second_writer")).crossJoin(missing)  # one row


def canonical_table(spark, folder):
    """Records written with their fingerprint and read back without their texts: rows, texts that occur once, audited groups."""
    path = fresh_path(spark, "canonical")
    C.write_canonical(R.parse_records(_record_texts(spark, folder).select("value"), views=False).where("id is not null and strict"), path)
    slim = C.planned(spark, path)
    facts = C.footer_facts(spark, path, ["id", "split_group"])
    gate = leakage.group_gate(slim, allow_inferred=True).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return slim.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("fingerprint").alias("texts"), F.count_distinct("split_group").alias("groups"),
        F.lit(facts["rows"]).alias("footer_rows"), F.lit(facts["split_group_values"]).alias("footer_groups"),
    ).crossJoin(gate.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("refused")))  # one row


def named_requests(spark, folder):
    """Requests at any depth of a record, found by their key: the base one and those of views in views."""
    part = lambda k, inner: F.concat(F.lit('{"request":{"state":'), F.col("props"), F.lit(f',"k":{k}}},"views":['), inner, F.lit("]}"))
    nested = F.lit("")
    for k in range(5, 0, -1):
        nested = part(k, nested)
    rows = X.table(spark, folder, "events").select("event_id", F.explode(R.requests_anywhere(part(0, nested))).alias("request"))
    return rows.select("event_id", F.get_json_object("request", "$.k").cast("int").alias("k"), F.md5("request").alias("request_md5"))


def table_digest(spark, folder):
    return K.table_digest(X.table(spark, folder, "orders"), ["o_orderkey", "o_orderpriority"])


def representation_stats(spark, folder):
    rows = X.table(spark, folder, "embeddings").select(F.col("embedding").cast("array<double>").alias("vector"))
    out = G.representation_stats(rows)
    return _rounded(out.select("count", "mean_norm", "direction_variance"), "mean_norm", "direction_variance")


def representation_rank_whole(spark, folder):
    """Effective rank of all vectors in all their dimensions."""
    rows = X.table(spark, folder, "embeddings").select(F.col("embedding").cast("array<double>").alias("vector"))
    return G.representation_stats(rows).select("count", F.round("effective_rank", 6).alias("effective_rank"))


def representation_rank(spark, folder):
    """Effective rank of all vectors, folded to two dimensions by the sums of their even and odd entries."""
    whole = F.col("embedding").cast("array<double>")
    part = lambda k: F.aggregate(F.filter(whole, lambda _, i: i % 2 == k), F.lit(0.0), lambda s, x: s + x)
    rows = X.table(spark, folder, "embeddings").select(F.array(part(0), part(1)).alias("vector"))
    return G.representation_stats(rows).select("count", F.round("effective_rank", 6).alias("effective_rank"))


def _log(rows):
    return rows.withColumn("line", F.concat(
        F.lit('{"step":'), F.col("event_id").cast("string"), F.lit(',"name":"x","dev":{"nll":'), F.col("value").cast("string"),
        F.lit(',"ok":true,"deep":{"user":'), F.col("user_id").cast("string"), F.lit('}},"list":[1]}')))


def metric_flatten(spark, folder):
    return L.scalar_metrics(_log(X.table(spark, folder, "events")), "line", ["event_id"])


def retained_steps(spark, folder):
    return L.retained_steps(X.table(spark, folder, "events"), ["user_id"], "event_id", "value", 3)


def best_step(spark, folder):
    return L.best_step(X.table(spark, folder, "events"), ["event_type"], "event_id", "value")


def _event_stream(spark, folder):
    schema = X.table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_calibration(spark, folder):
    """Calibration error per closed day."""
    rows = _event_stream(spark, folder).select(
        "ts", F.lit(1.0).alias("weight"), F.least(F.lit(0.99), 0.25 + F.col("value") / 700.0).alias("top_probability"),
        (F.col("event_type") == "click").cast("double").alias("accuracy"))
    out = J.calibration_by_window(J.run_to_table(J.calibration_bins(rows, "ts", delay="1 hour", window="1 day")))
    return _rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd")), "ece", "accuracy")


def stream_log_metrics(spark, folder):
    out = J.run_to_table(J.log_metrics(_log(_event_stream(spark, folder)), "line", "ts", delay="1 hour", window="6 hours"))
    return _rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH")), "mean", "low", "high")


def stream_dedup(spark, folder):
    rows = J.distinct_states(_event_stream(spark, folder), F.concat_ws(":", "event_type", "user_id"), "ts", "1 hour")
    return J.run_to_table(rows.select("event_type", "user_id"))


BATCHES = 6  # arrivals of the events by time; some come one or two batches late


def _arrivals(spark, folder, files=2):
    """The events as a stream of BATCHES + 2 micro-batches: every 17th event arrives two batches late, every fifth of the others one."""
    base = fresh_path(spark, "arrivals")
    events = X.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    late = F.when(F.col("event_id") % 17 == 0, 2).when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    slot = F.expr(f"({BATCHES} * (unix_micros(ts) - lo)) div (hi - lo + 1)") + late
    dealt = stored(events.crossJoin(F.broadcast(span)).withColumn("arrival", slot).drop("lo", "hi"), "dealt")  # one row of bounds
    for k in range(BATCHES + 2):
        dealt.where(F.col("arrival") == k).drop("arrival").repartition(files, "event_id").write.parquet(f"{base}/arrival={k}")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/*")
    return rows


# Batch of every event, and the watermark (in milliseconds, before the delay) that the rows of each batch are late against: the highest time
# seen two batches before.
_ARRIVALS = f"""span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
arrived AS (SELECT e.*, CAST(({BATCHES} * (epoch_us(ts) - lo)) // (hi - lo + 1) + CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS b
  FROM events e, span),
tops AS (SELECT b, max(epoch_ms(ts)) AS top FROM arrived GROUP BY b),
marks AS (SELECT b, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS late_ms FROM tops),
dated AS (SELECT a.*, coalesce(late_ms, -1e18) AS late_ms FROM arrived a JOIN marks m ON a.b = m.b)"""


def stream_reuse(spark, folder):
    """States encoded once per hour's horizon over several micro-batches: answered rows, encoder runs and the value by state and day."""
    rows = _arrivals(spark, folder).withColumn("state", F.concat_ws(":", "event_type", F.col("user_id") % 20))
    out = J.run_to_table(reuse_states(rows, "state", "ts", lambda s: float(sum(s.encode())), code="double", delay="2 hours", horizon=86400))
    return out.groupBy("state", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("answered"), F.sum(F.col("fresh").cast("long")).alias("encoded"), F.min("code").alias("low"), F.max("code").alias("high"))


def stream_sliding_calibration(spark, folder):
    """Calibration error per sliding window of two days, from late and out-of-order arrivals."""
    rows = _arrivals(spark, folder).select(
        "ts", F.lit(1.0).alias("weight"), F.least(F.lit(0.99), 0.25 + F.col("value") / 700.0).alias("top_probability"),
        (F.col("event_type") == "click").cast("double").alias("accuracy"))
    out = J.calibration_by_window(J.run_to_table(J.calibration_bins(rows, "ts", delay="1 hour", window="2 days", slide="1 day")))
    return _rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd")), "ece", "accuracy")


def stream_throughput(spark, folder):
    """Rows and tokens per second of each closed day, from late and out-of-order arrivals."""
    rows = _arrivals(spark, folder).withColumn("tokens", F.size(F.split("props", "[ :,]+")).cast("long"))
    out = J.run_to_table(J.throughput(rows, "ts", ["tokens"], delay="1 hour", window="1 day"))
    return _rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd")), "seconds", "rows_per_second", "tokens_per_second")


def deep_metrics(spark, folder):
    """Numbers of a log whose objects nest 40 deep."""
    head, tail = '{"n":' * 39, "}" * 39
    rows = X.table(spark, folder, "events").select("event_id", F.concat(F.lit(head + '{"v":'), F.col("value").cast("string"), F.lit("}" + tail)).alias("line"))
    return L.scalar_metrics(rows, "line", ["event_id"])


def stream_answers(spark, folder):
    """Answers of a prediction stream against a static temperature table."""
    temps = spark.createDataFrame([("noul", 2.0)], "key string, value double")
    rows = _event_stream(spark, folder).select(
        F.col("event_id").alias("id"), F.lit("noul").alias("type"), X.names(["true", "false"]).alias("keys"),
        F.array((F.col("value") - 100) / 50.0, F.lit(0.0)).alias("logits"))
    out = J.run_to_table(J.stream_answers(rows, temps).select("id", "noul"))
    return _rounded(out, "noul")


def stream_quarantine(spark, folder):
    """Request bodies routed to a good and a dead-letter table."""
    base = fresh_path(spark, "route")
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.concat("props", F.lit(" x"))).when(k == 1, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    words = F.size(F.split("value", " "))
    J.run_batches(_arrivals(spark, folder).select("event_id", body.alias("value")),
                  J.route_requests(f"{base}/good", f"{base}/dead", tokens=words + F.length("value") % 3, budget=3))
    good = spark.read.parquet(f"{base}/good").select("event_id", F.lit("ok").alias("result"))
    dead = spark.read.parquet(f"{base}/dead").select("event_id", F.concat_ws(":", "error", "admission").alias("result"))
    return good.unionByName(dead)


def stream_leakage(spark, folder):
    """Arriving records whose group already belongs to the training split are refused."""
    base = fresh_path(spark, "gate")
    X.table(spark, folder, "customer").filter("c_custkey % 4 = 0").select(
        F.lit("train").alias("split"), F.col("c_custkey").cast("string").alias("key")).write.parquet(f"{base}/sources/batch=-1")
    rows = _event_stream(spark, folder).select("event_id", F.col("user_id").cast("string").alias("split_group"))
    J.run_batches(rows, J.leakage_gate(spark, f"{base}/sources", f"{base}/good", f"{base}/bad", "test"))
    bad = spark.read.parquet(f"{base}/bad").select(F.lit("refused").alias("result"), "split_group")
    good = spark.read.parquet(f"{base}/good").select(F.lit("accepted").alias("result"), "split_group")
    added = spark.read.parquet(f"{base}/sources").filter("batch >= 0").select(F.lit("source").alias("result"), F.col("key").alias("split_group"))
    return bad.unionByName(good).unionByName(added).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_source, json_array_source, csv_source, benchmark_cases, packed_roundtrip,
        packed_integrity, image_audit, token_publish, table_digest, representation_stats,
        representation_rank, metric_flatten, retained_steps, best_step, stream_calibration,
        stream_log_metrics, stream_dedup, stream_answers, stream_quarantine, stream_leakage, stream_reuse,
        stream_sliding_calibration, stream_throughput, deep_metrics, token_snapshots, canonical_table, named_requests, representation_rank_whole,
    )
}

_CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
_BAD = ",".join(str(i) for i, (_n, r) in enumerate(DAMAGE) if r == "strict_json")

# Words as the built-in tokenizer cuts them; a marker's spelling becomes its nine bytes.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '<unused[01]>|[A-Za-z0-9À-ɏ]+|[^ \t\r\nA-Za-z0-9À-ɏ]')"
_COST = f"(len({_WORDS}) + 8 * len(list_filter({_WORDS}, lambda w: w IN ('<unused0>', '<unused1>'))))"

ORACLE = {
    "jsonl_source": f"SELECT CASE WHEN event_id % 16 IN ({_BAD}) THEN 'strict_json' ELSE 'ok' END AS problem, count(*) AS n FROM events GROUP BY 1",
    "json_array_source": """SELECT CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS position, n_name AS name,
  CAST(n_nationkey AS VARCHAR) AS key FROM nation""",
    "csv_source": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'a "q", ' || c_name AS c_name, c_mktsegment FROM customer""",
    "benchmark_cases": """SELECT vec_id AS id, 'q' AS qid, 'choice' AS type, CASE WHEN label < 5 THEN 'no' ELSE 'yes' END AS label, 'yes,no' AS keys,
  CAST('0.' || label AS DOUBLE) AS first FROM embeddings""",
    "packed_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 3 AS INTEGER) AS images, 1 AS same, lang AS dataset FROM documents",
    "packed_integrity": """SELECT CAST(doc_id AS VARCHAR) AS doc, CASE WHEN doc_id % 5 = 1 THEN 'identity' WHEN doc_id % 5 = 2 AND doc_id % 3 > 0 THEN 'image_index'
  WHEN doc_id % 5 = 3 AND doc_id % 3 > 0 THEN 'image_bytes' WHEN doc_id % 5 = 4 THEN 'references' ELSE 'ok' END AS problem FROM documents""",
    "image_audit": "SELECT doc_id, ['ok', 'ok', 'ok', 'media_type', 'animation', 'empty_image_bytes'][doc_id % 6 + 1] AS problem FROM documents",
    "token_publish": f"SELECT lang AS _split_group, count(*) AS n, CAST(sum({_COST}) AS BIGINT) AS tokens FROM documents GROUP BY 1",
    "token_snapshots": f"""SELECT v AS version, CASE WHEN v = 1 THEN 0 END AS parent, count(*) AS rows, CAST(sum({_COST}) AS BIGINT) AS tokens, count(*) AS costs,
  0 AS second_writer, 0 AS untokenized FROM documents, (VALUES (0), (1)) t(v) WHERE v = 0 OR doc_id % 2 = 0 GROUP BY v""",
    "canonical_table": f"""SELECT count(*) AS rows, count(*) AS texts, count(DISTINCT user_id) AS groups, count(*) AS footer_rows, count(*) AS footer_groups, 0 AS refused
FROM events WHERE event_id % 16 NOT IN ({_BAD})""",
    "named_requests": """SELECT event_id, k, md5('{"state":' || replace(props, ': ', ':') || ',"k":' || k || '}') AS request_md5 FROM events, range(6) t(k)""",
    "representation_rank": """WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)),
s AS (SELECT sum(v) FILTER (WHERE i % 2 = 1) AS x, sum(v) FILTER (WHERE i % 2 = 0) AS y FROM e GROUP BY vec_id),
u AS (SELECT x / greatest(sqrt(x * x + y * y), 1e-12) AS x, y / greatest(sqrt(x * x + y * y), 1e-12) AS y FROM s),
m AS (SELECT count(*) AS n, avg(x * x) - avg(x) ** 2 AS a, avg(y * y) - avg(y) ** 2 AS d, avg(x * y) - avg(x) * avg(y) AS b FROM u),
l AS (SELECT n, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS p, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS q FROM m)
SELECT n AS count, round(exp(-(p / (p + q) * ln(p / (p + q)) + q / (p + q) * ln(q / (p + q)))), 6) AS effective_rank FROM l""",
    "table_digest": """WITH h AS (SELECT sha256('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS s FROM orders)
SELECT count(*) AS rows, sha256(concat_ws(':', """ + ", ".join(
        f"CAST(sum(CAST('0x' || substr(s, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)" for i in range(4)) + ")) AS digest FROM h",
    "representation_stats": f"""WITH v AS (SELECT vec_id, j, CAST(embedding[j] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(1, 65) r(j)),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS count, {r6('(SELECT avg(norm) FROM n)')} AS mean_norm,
  {r6('(SELECT avg(s) FROM (SELECT j, var_pop(x / norm) AS s FROM v JOIN n USING (vec_id) GROUP BY j))')} AS direction_variance""",
    "metric_flatten": """SELECT event_id, 'step' AS name, CAST(event_id AS DOUBLE) AS value FROM events UNION ALL
SELECT event_id, 'dev/nll', value FROM events UNION ALL SELECT event_id, 'dev/deep/user', user_id FROM events""",
    "retained_steps": """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS b FROM events) SELECT user_id, event_id FROM r WHERE n <= 3 OR b = 1""",
    "best_step": """SELECT event_type, event_id AS best_step, value AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS b FROM events) WHERE b = 1""",
    "stream_calibration": f"""WITH q AS (SELECT date_trunc('day', ts) AS d, least(0.99, 0.25 + value / 700.0) AS top, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS hit FROM events),
b AS (SELECT d, least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, sum(top) AS t, sum(hit) AS h, count(*) AS n FROM q WHERE d + INTERVAL 1 DAY {_CLOSED} GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS start, {r6('sum(abs(t - h)) / sum(n)')} AS ece, {r6('sum(h) / sum(n)')} AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY d""",
    "stream_log_metrics": f"""WITH l AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS d, unnest(['step', 'dev/nll', 'dev/deep/user']) AS name,
  unnest([CAST(event_id AS DOUBLE), value, CAST(user_id AS DOUBLE)]) AS v FROM events)
SELECT strftime(d, '%Y-%m-%d %H') AS start, name, count(*) AS n, {r6('avg(v)')} AS mean, {r6('min(v)')} AS low, {r6('max(v)')} AS high
FROM l WHERE d + INTERVAL 6 HOUR {_CLOSED} GROUP BY d, name""",
    "stream_dedup": "SELECT DISTINCT event_type, user_id FROM events",
    "stream_answers": f"SELECT event_id AS id, {r6('1 / (1 + exp(-(value - 100) / 100.0))')} AS noul FROM events",
    "stream_quarantine": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'invalid_request:strict_json' WHEN 1 THEN 'invalid_request:object'
  ELSE CASE WHEN len(string_split(props, ' ')) + length(props) % 3 > 3 THEN 'capacity:budget' ELSE 'ok' END END AS result FROM events""",
    "stream_reuse": f"""WITH {_ARRIVALS},
kept AS (SELECT event_type || ':' || (user_id % 20) AS state, strftime(ts, '%Y-%m-%d') AS day FROM dated WHERE epoch_us(ts) > (late_ms - 7200000) * 1000)
SELECT state, day, count(*) AS answered, 1 AS encoded, CAST(list_sum(list_transform(string_split(state, ''), lambda c: ascii(c))) AS DOUBLE) AS low,
  CAST(list_sum(list_transform(string_split(state, ''), lambda c: ascii(c))) AS DOUBLE) AS high FROM kept GROUP BY state, day""",
    "stream_sliding_calibration": f"""WITH {_ARRIVALS},
placed AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS d, least(0.99, 0.25 + value / 700.0) AS top,
  CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS hit, late_ms FROM dated, range(2) r(k)),
b AS (SELECT d, least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, sum(top) AS t, sum(hit) AS h, count(*) AS n FROM placed
  WHERE epoch_ms(d + INTERVAL 2 DAY) > late_ms - 3600000 AND d + INTERVAL 2 DAY {_CLOSED} GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS start, {r6('sum(abs(t - h)) / sum(n)')} AS ece, {r6('sum(h) / sum(n)')} AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY d""",
    "stream_throughput": f"""WITH {_ARRIVALS},
w AS (SELECT date_trunc('day', ts) AS d, count(*) AS rows, CAST(sum(len(regexp_split_to_array(props, '[ :,]+'))) AS BIGINT) AS tokens,
  (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds FROM dated
  WHERE epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY) > late_ms - 3600000 AND date_trunc('day', ts) + INTERVAL 1 DAY {_CLOSED} GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS start, rows, tokens, {r6('seconds')} AS seconds, {r6('rows / nullif(seconds, 0)')} AS rows_per_second,
  {r6('tokens / nullif(seconds, 0)')} AS tokens_per_second FROM w""",
    "deep_metrics": f"SELECT event_id, '{'n/' * 39}v' AS name, value FROM events",
    "stream_leakage": """WITH t AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)
SELECT CASE WHEN user_id IN (SELECT c_custkey FROM t) THEN 'refused' ELSE 'accepted' END AS result, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'source', count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM t)""",
}
