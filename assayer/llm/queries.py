"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, chat, context_tree, decontaminate, language, lexical, line_dedup, near_dedup, neighbours, packing, periodic, quality, url_filter
from assayer.llm.shared import remainder


BATCH_BYTES = 4 << 20  # of an Arrow batch


def tokenizer(name: str) -> str:
    """Where the installed public vocabulary file lies, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Python workers import this package from where the driver did, whatever folder the driver was started in
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    # a batch of rows that Python gets is bounded by its bytes: ten thousand long texts at once would fill the workers
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    found = line_dedup.dedup_lines(docs.withColumn("n_lines", lines))
    return found.select("doc_id", "n_lines", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    found = line_dedup.dedup_passages(docs.withColumn("n_lines", lines))
    return found.select("doc_id", "n_lines", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("th")


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(table(spark, folder, "conversations"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, i, a, a[i + 1] AS line, CAST('0x' || substr(md5(a[i + 1]), 1, 7) AS BIGINT) AS f
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(range(len(a))) AS t(i)
), near AS (
  SELECT *, lead(f) OVER w AS after, lag(f) OVER w AS before FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), marked AS (
  SELECT doc_id, i, a, s, (3 * f + after) >> s AS begins, min(CASE WHEN ((5 * before + f) >> s) % 2 = 0 THEN i END)
    OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS j
  FROM near, range(1, 9) r(s)
), spans AS (
  SELECT DISTINCT doc_id, i, j, a[i + 1:j + 1] AS c FROM marked WHERE begins % 2 = 0 AND j IS NOT NULL
), chunks AS (
  SELECT doc_id, i, j, array_to_string(c, chr(10)) AS body FROM spans
  WHERE len(list_filter(c, lambda x: NOT regexp_full_match(x, '[ \\t-\\r]*'))) > 1
), ranked AS (
  SELECT *, first(doc_id) OVER w AS first_doc, first(i) OVER w AS first_line FROM chunks WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, line FROM ranked, unnest(range(i, j + 1)) AS t(line) WHERE doc_id <> first_doc OR i - first_line > j - i
), kept AS (
  SELECT p.doc_id, count(*) AS n_lines, count(g.doc_id) AS removed_lines,
    coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE g.doc_id IS NULL), '') AS text
  FROM lines p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.line GROUP BY p.doc_id
)
SELECT doc_id, n_lines, removed_lines, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM kept
"""


OP7_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS a
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(a[i:i + 2], ' ') AS g FROM words, unnest(range(1, len(a) - 1)) AS t(i) WHERE len(a) >= 3
  UNION ALL SELECT doc_id, array_to_string(a, ' ') FROM words WHERE len(a) BETWEEN 1 AND 2
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT s.b, r.root FROM reach r JOIN sides s ON s.a = r.doc_id
), least AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ALLOWED = ["org/", "com/fr/"]
BLOCKED = ["example.org/es/", "example.org/en/1", "com/de/"]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_of(spark, ALLOWED, BLOCKED)).drop("url")


OP1_SQL = """
WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')
), rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM rest
)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) = 1
"""


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    net = language.fit(docs, ~held_out)
    return language.identify(docs.withColumn("held_out", held_out), net, ["doc_id", "held_out"])


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return neighbours.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), ~quality.held_out(F.col("doc_id")))
    scored = quality.score(docs.withColumn("held_out", quality.held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_context_tree_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    return context_tree.score(docs.withColumn("held_out", held_out), ~held_out, ["doc_id", "held_out"])


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a
  FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS often FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY item_id, term
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(len(a)) AS BIGINT) AS n_terms FROM docs WHERE len(a) > 0
), counts AS (
  SELECT doc_id, len(a) AS n, term, count(*) AS tf FROM (SELECT doc_id, a, unnest(a) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, len(a), term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, n_docs
), impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)) AS impact FROM counts, total
), scores AS (
  SELECT item_id, doc_id, CAST(sum(often * w * impact) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    return bpe.digest(bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by hash repeats a stretch of its words to its end; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", "[ \\x09-\\x0D]+", -1), lambda w: w != ""))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    parts = docs.withColumns({"h": h, "words": words}).withColumns({"g": g, "n": n}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    parts = parts.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return parts.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find_runs(with_planted_runs(table(spark, folder, "documents").select("doc_id", "text")))
    return periodic.digest(found)


OP13_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents
), sized AS (
  SELECT doc_id, w, len(w) AS n, xor(crc, 4294967295::BIGINT) AS h FROM split
), planted AS (
  SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM sized
), docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM planted
), grams AS (
  SELECT doc_id, i, w[i + 1:i + 5] AS g FROM docs, unnest(range(n - 4)) AS t(i) WHERE n >= 6
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i
), placed AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS len FROM placed GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= 4 * q AND len >= 6 GROUP BY doc_id, s, len
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS rows,
    list(struct_pack(s := s, len := len, q := q)) AS all_runs FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, (1000 * b.len) // b.q AS exponent_milli,
  sha256(coalesce(rows, '')) AS runs_sha256,
  sha256(array_to_string(list_transform(list_filter(range(d.n), lambda i: len(list_filter(coalesce(all_runs, []), lambda r: i >= r.s + r.q AND i < r.s + r.len)) = 0), lambda i: d.w[i + 1]), ' ')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_line_dedup": op6_line_dedup,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_quality": op9_quality,
    "op10_context_tree_score": op10_context_tree_score,
    "op11_ranked_search": op11_ranked_search,
    "op12_bpe": op12_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_periodic_runs": OP13_SQL,
}
