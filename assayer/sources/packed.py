"""Packed records: JSON text plus image bytes in one Parquet table, and token columns beside them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.constants import TOKEN_COLUMNS
from assayer.functions import json as J
from assayer.operators import records as R
from assayer.operators.validate import evaluated_once
from assayer.session import package_path
from assayer.sources import versions

FORMAT = "packed-images-1"
ROW_GROUP_BYTES = 16 * 1024 * 1024
IMAGE = "array<struct<bytes:binary,path:string>>"

# Leading bytes (hex) of the three picture types, and file name endings.
MAGIC = {"image/png": "^89504E470D0A1A0A", "image/jpeg": "^FFD8FF", "image/webp": "^52494646.{8}57454250"}
ENDINGS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def decode_image(url: Column) -> Column:
    """STRUCT<mime, bytes> of a data URL; ``bytes`` is NULL when the payload is no strict base64."""
    payload = F.substring_index(url, ",", -1)
    sound = payload.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(payload) % 4 == 0)
    return F.struct(
        F.regexp_extract(url, r"^data:([a-z/]+);base64,", 1).alias("mime"),
        F.when(sound, F.try_to_binary(payload, F.lit("base64"))).alias("bytes"),
    )


def _animated(mime: str, content: bytes) -> bool:
    """Whether the chunks of a PNG before its first data chunk, or those of a WebP, announce an animation."""
    at, end = (8, len(content)) if mime == "image/png" else (12, len(content))
    while at + 8 <= end:
        if mime == "image/png":
            size, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            if name in (b"acTL", b"IDAT", b"IEND"):
                return name == b"acTL"
            at += 12 + size
        else:
            name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
            if name == b"ANIM":
                return True
            at += 8 + size + size % 2
    return False


def image_problem(mime: Column, content: Column) -> Column:
    """Why an image is refused: empty, not of the declared type, or animated (by its chunk headers); else NULL."""

    def run(mimes: pa.Array, contents: pa.Array) -> pa.Array:
        pairs = zip(mimes.to_pylist(), contents)
        return pa.array([c.is_valid and m in ("image/png", "image/webp") and _animated(m, c.as_buffer().to_pybytes()) for m, c in pairs], pa.bool_())

    package_path(SparkSession.getActiveSession())
    head = F.hex(F.substring(content, 1, 12))
    fits = F.lit(False)
    for name, pattern in MAGIC.items():
        fits = fits | ((mime == name) & head.rlike(pattern))
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "empty_image_bytes")
        .when(~fits, "media_type").when(F.arrow_udf(run, "boolean")(mime, content), "animation")
    )


URLS = "array<string>"
REFERENCES = "array<struct<image_index:int,mime_type:string>>"


def _reference_texts(urls: Column, start: Column) -> Column:
    return F.transform(
        urls,
        lambda u, i: F.concat(
            F.lit('{"image_index":'), (start + i).cast("string"), F.lit(',"mime_type":'),
            J.quote(decode_image(u)["mime"]), F.lit("}"),
        ),
    )


def _replaced(text: Column, name: str, value) -> Column:
    """A JSON object whose member ``name`` is replaced by ``value(its JSON text)``; the others keep their wording and order."""

    def rebuilt(m: Column) -> Column:
        own = lambda e: F.when(e["kind"].isin("integer", "float"), e["text"]).otherwise(e["json"])
        values = F.transform(m, lambda e: F.when(e["key"] == name, value(e["json"])).otherwise(own(e)))
        return J.object_from(F.transform(m, lambda e: e["key"]), values)

    return J.let(J.entries(text), rebuilt)


def _with_references(text: Column, base: Column, start) -> Column:
    """The record's own text with references in place of its images."""
    urls = lambda listed: F.from_json(listed, URLS)
    listed = lambda t, at: J.array_of(_reference_texts(urls(t), at))
    own = _replaced(text, "request", lambda r: _replaced(r, "images", lambda t: listed(t, F.lit(0))))

    def views(found: Column) -> Column:
        each = F.transform(
            J.items(found),
            lambda v, i: _replaced(v["json"], "request", lambda r: _replaced(r, "images", lambda t: listed(t, start(i)))),
        )
        return J.array_of(each)

    return _replaced(own, "views", views)


def pack(records: DataFrame) -> DataFrame:
    """Packed rows of typed records: id, dataset, schema_version, record_json, images, problem.

    Images of the base request come first, then those of each view; the text holds references. Records that carry their own text (``record_json``, as parsed ones
    do) keep it but for the images, so nothing that was written is lost; others are rendered.
    """
    none = F.array().cast(URLS)
    base = F.coalesce(F.col("request.images"), none)
    if "views" in records.columns:
        per_view = F.coalesce(
            F.transform("views", lambda v: F.coalesce(v["request"]["images"], none)),
            F.array().cast("array<array<string>>"),
        )
    else:
        per_view = F.array().cast("array<array<string>>")

    def start(i: Column) -> Column:
        earlier = F.slice("__per_view", F.lit(1), i)
        return F.size(base) + F.aggregate(earlier, F.lit(0), lambda s, u: s + F.size(u))

    rows = records.withColumn("__per_view", per_view)
    rows = rows.withColumn("__decoded", F.transform(F.concat(base, F.flatten("__per_view")), decode_image))
    if "record_json" in records.columns:
        text = _with_references(F.col("record_json"), base, start)
    else:
        text = R.record_json(
            rows, _reference_texts(base, F.lit(0)),
            lambda v, i: _reference_texts(v["request"]["images"], start(i)),
        )
    empty = F.exists("__decoded", lambda d: d["bytes"].isNull() | (F.octet_length(d["bytes"]) == 0))
    return rows.select(
        "id", "dataset", "schema_version", text.alias("record_json"),
        F.transform(
            "__decoded",
            lambda d: F.struct(d["bytes"].alias("bytes"), F.lit(None).cast("string").alias("path")),
        ).alias("images"),
        evaluated_once(F.when(empty, "empty_image_bytes")).alias("problem"),
    )


def embed_files(records: DataFrame, spark: SparkSession, path: str, column: str = "image_path") -> DataFrame:
    """Replace a file path by a data URL of its bytes. The type comes from the file name ending.

    A relative path is taken from ``path``; files match on their whole path, not on their name.
    """

    def plain(p: Column) -> Column:
        p = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
        return F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), "/+", "/")

    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    mime = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), ending)
    files = spark.read.format("binaryFile").load(path).select(
        plain(F.col("path")).alias("__file"), mime.isNull().alias("__unknown"),
        F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")).alias("image"),
    )
    own = F.col(column)
    full = F.when(own.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), own).otherwise(F.concat(F.lit(path + "/"), own))
    joined = records.withColumn("__file", plain(full)).join(files, "__file", "left")
    problem = F.when(F.col("__unknown").isNull(), "no_such_file").when(F.col("__unknown"), "unknown_image_type")
    return joined.withColumn("image_problem", problem).drop("__file", "__unknown")


def write_packed(packed: DataFrame, path: str, *, max_rows: int | None = None) -> None:
    """One folder per dataset; zstd, dictionary only where values repeat, 16 MiB row groups.

    Rebalancing by dataset gives small datasets one file each and splits a large one over tasks.
    """
    writer = (
        packed.select("id", "dataset", "schema_version", "record_json", "images")
        .withMetadata("record_json", {"format": FORMAT})
        .hint("rebalance", F.col("dataset")).write.mode("overwrite").option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#schema_version", "true")
    )
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.partitionBy("dataset").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Packed rows. A table whose footers do not name the format is an error."""
    stored = {f.name: f.metadata.get("format") for f in spark.read.parquet(path).schema.fields}
    if stored.get("record_json") != FORMAT:
        raise ValueError(f"{path} holds no packed records")
    columns = f"id string, schema_version string, record_json string, images {IMAGE}, dataset string"
    return spark.read.schema(columns).parquet(path)


def _with_members(df: DataFrame) -> DataFrame:
    """Add ``__members``: those of the record's text, read once and used several times."""
    return df.withColumn("__members", J.entries(F.col("record_json")))


def references(df: DataFrame) -> DataFrame:
    """Add ``refs``: image references of the base request and all views, in order."""
    return _references(_with_members(df)).drop("__members")


def _references(df: DataFrame) -> DataFrame:
    members = F.col("__members")
    request = J.entries(J.member(members, "request"))
    views = F.transform(
        J.items(J.member(members, "views")), lambda v: J.member(J.entries(v["json"]), "request")
    )
    texts = F.concat(
        F.array(J.member(request, "images")),
        F.coalesce(F.transform(views, lambda r: J.member(J.entries(r), "images")), F.array().cast("array<string>")),
    )
    parsed = F.flatten(
        F.transform(
            F.filter(texts, lambda t: t.isNotNull()),
            lambda t: F.from_json(t, REFERENCES),
        )
    )
    return df.withColumn("refs", F.coalesce(parsed, F.array().cast(REFERENCES)))


def packed_problem(df: DataFrame) -> DataFrame:
    """Add ``problem``: identity, image index, image bytes or reference count; NULL when sound."""
    df = _references(_with_members(df))
    members = F.col("__members")
    text = lambda n: F.get(F.filter(members, lambda e: e["key"] == n), F.lit(0))["text"]
    n = F.size("images")
    used = F.array_sort(F.transform("refs", lambda r: r["image_index"]))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    problem = (
        F.when(~(text("id").eqNullSafe(F.col("id")) & text("schema_version").eqNullSafe(F.col("schema_version"))), "identity")
        .when(F.exists("refs", lambda r: F.coalesce(~r["image_index"].between(0, n - 1), F.lit(True))), "image_index")
        .when(
            F.exists("images", lambda i: i["bytes"].isNull() | (F.octet_length(i["bytes"]) == 0) | i["path"].isNotNull()),
            "image_bytes",
        )
        .when(used != every, "references")
    )
    return df.withColumn("problem", evaluated_once(problem)).drop("__members")


def _url(reference: Column) -> Column:
    return F.concat(
        F.lit("data:"), reference["mime_type"], F.lit(";base64,"),
        F.base64(F.get(F.col("images"), reference["image_index"])["bytes"]),
    )


def _restored_request(text: Column) -> Column:
    def rebuilt(m: Column) -> Column:
        values = F.transform(
            m,
            lambda e: F.when(
                e["key"] == "images",
                J.array_of(F.transform(F.from_json(e["json"], REFERENCES), lambda r: J.quote(_url(r)))),
            ).otherwise(e["json"]),
        )
        return J.object_from(F.transform(m, lambda e: e["key"]), values)

    return J.let(J.entries(text), rebuilt)


def unpack(df: DataFrame) -> DataFrame:
    """Add ``value``: the record text with its data URLs back in place. Only sound rows should be
    passed."""
    members = F.col("__members")

    def with_request(item: Column) -> Column:
        m = J.entries(item["json"])
        values = F.transform(
            m, lambda e: F.when(e["key"] == "request", _restored_request(e["json"])).otherwise(e["json"])
        )
        return J.object_from(F.transform(m, lambda e: e["key"]), values)

    values = F.transform(
        members,
        lambda e: F.when(e["key"] == "request", _restored_request(e["json"]))
        .when(e["key"] == "views", J.array_of(F.transform(J.items(e["json"]), with_request)))
        .otherwise(e["json"]),
    )
    return _with_members(df).withColumn("value", J.object_from(F.transform(members, lambda e: e["key"]), values)).drop("__members")


def publish_tokens(
    spark: SparkSession, rows: DataFrame, tokens: DataFrame, path: str, settings: dict, *, after: int | None = -1, tries: int = 5
) -> int:
    """Write rows with their token columns as a new version, see ``versions``.

    Old token columns are replaced. The version becomes visible only after every id is written as often as the input has it; a failed write leaves the
    previous one in place. The version's state says per split group how many rows and tokens it has, and binds the costs by their digest. With ``after`` (a version, or None for an empty log)
    the write fails with Conflict if another writer came first; without it the next free version is taken.
    """
    base = rows.drop(*[c for c in TOKEN_COLUMNS if c in rows.columns])
    target = versions.new_folder(path)
    base.join(tokens, "id").write.mode("errorifexists").option("compression", "zstd").parquet(target)
    written = spark.read.parquet(target)
    wanted = base.groupBy("id").agg(F.count(F.lit(1)).alias("wanted"))
    both = wanted.join(written.groupBy("id").agg(F.count(F.lit(1)).alias("written")), "id", "full")
    bad = both.agg(F.count_if(~F.col("wanted").eqNullSafe(F.col("written"))).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"tokenization lost or repeated {bad} ids")
    state = snapshot_state(written)
    if after != -1:
        return versions.commit(spark, path, target, settings, state, after=after)
    for _ in range(tries):
        now = versions.latest(spark, path)
        try:
            return versions.commit(spark, path, target, settings, state, after=now["version"] if now else None)
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{tries} other writers came first")


def snapshot_state(written: DataFrame) -> dict:
    """Rows, tokens of the base requests and an order-free digest of ids and costs."""
    if "_token_costs" not in written.columns:
        written = written.withColumn("_token_costs", F.lit(None).cast("array<int>"))
    cost = F.get("_token_costs", F.lit(0)).cast("long")
    row = F.sha2(F.to_json(F.struct("id", "_token_costs")), 256)
    facts = written.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(cost), F.lit(0)).alias("tokens"), F.coalesce(F.min(cost), F.lit(0)).alias("least"),
        F.count("_token_costs").alias("costs"), _order_free(row).alias("digest"),
    ).first()
    return facts.asDict()


def read_tokens(spark: SparkSession, path: str, settings: dict, *, check: bool = False) -> DataFrame:
    """The latest version; stored settings must equal the current ones. With ``check`` the rows must still be those that its state describes."""
    entry = versions.latest(spark, path)
    if entry is None:
        raise ValueError(f"{path} holds no version")
    if json.loads(entry["settings"]) != settings:
        raise ValueError("stored token ids use different settings; tokenize again")
    rows = spark.read.parquet(entry["data"])
    if check and snapshot_state(rows) != json.loads(entry["state"]):
        raise ValueError("stored tokens are not those that were published")
    return rows


def _order_free(row_hash: Column) -> Column:
    """One digest of a set of row hashes from sums of their parts: no order, no collection."""
    part = lambda i: F.conv(F.substring(row_hash, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    return F.sha2(F.concat_ws(":", *[F.sum(part(i)).cast("string") for i in range(4)]), 256)


def split_manifest(files: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per split: number of files, bytes and an order-free digest of the file digests."""
    return files.join(splits, "path").groupBy("split").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
        _order_free(F.col("sha256")).alias("digest"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file, computed where the file is read."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table from its row hashes, combined map-side."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    return df.agg(F.count(F.lit(1)).alias("rows"), _order_free(row).alias("digest"))


def read_temperatures(spark: SparkSession, path: str, model_sha256: str) -> DataFrame:
    """(key, value) of a fitted report, which must belong to the given model."""
    rows = spark.read.parquet(path)
    bound = F.when(F.col("model_sha256") == model_sha256, F.col("temperature")).otherwise(
        F.raise_error("calibration belongs to a different model").cast("double")
    )
    return rows.select("key", bound.alias("value"))

