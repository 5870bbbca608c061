"""Decision tables derived from the driver tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.constants import ALLOWED_SET, BERNOULLI, BOOLEAN, CHOICE, CLASS, DISTRIBUTION, SCORE
from assayer.session import compilable, spread

# Tables whose queries compute much per row.
SPREAD = ("lineitem", "orders", "events", "documents", "embeddings", "customer", "part")
ROWS_PER_TASK = 50_000
ROWS_OF = {"lineitem": 500_000}  # a few numbers a row: what a task takes to begin would be most of its time
DIGITS = [str(i) for i in range(10)]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table. How its files split says little: a row group is read by one task, and a compressed row is a few bytes. So tables whose queries compute much per
    row are spread over the cores before any arithmetic, at most ROWS_PER_TASK rows to a task (or ROWS_OF), by the number of rows in the footers."""
    compilable(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, ROWS_OF.get(name, ROWS_PER_TASK)) if name in SPREAD else df


def names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


DIMS = 64


def dims(shift: int, count: int = 10, factor: float = 4.0) -> Column:
    """All 64 embedding entries folded into ``count`` doubles: entry k sums every ``count``-th one from k on, after a rotation
    by ``shift``, scaled."""

    def entry(k: int) -> Column:
        terms = [F.get("embedding", F.lit((at + shift) % DIMS)).cast("double") for at in range(k, DIMS, count)]
        out = terms[0]
        for term in terms[1:]:
            out = out + term
        return out * factor

    return F.array(*[entry(k) for k in range(count)])


def cut_dims(start: int, count: int, factor: float = 1.0) -> Column:
    """Neighbouring embedding entries as doubles, scaled."""
    return F.transform(
        F.slice("embedding", start + 1, count), lambda x: x.cast("double") * factor
    )


def softmax_of(z: Column) -> Column:
    e = F.transform(z, F.exp)
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def choice10(spark, folder, logits: Column | None = None) -> DataFrame:
    """One ten-way choice per vector; the label is the class."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.lit("label").alias("qid"),
        F.lit(CHOICE).alias("type"),
        F.lit(CLASS).alias("kind"),
        names(DIGITS).alias("keys"),
        (logits if logits is not None else dims(0)).alias("logits"),
        F.col("label").cast("string").alias("value"),
        F.lit(1.0).alias("weight"),
        "label",
        "embedding",
    )


def soft10(spark, folder) -> DataFrame:
    """The same logits against a soft target from dimensions 20-29."""
    return choice10(spark, folder).drop("value").withColumns(
        {"kind": F.lit(DISTRIBUTION), "dist": softmax_of(dims(20))}
    )


def allowed10(spark, folder) -> DataFrame:
    """Two acceptable labels per vector."""
    return choice10(spark, folder).drop("value").withColumns(
        {
            "kind": F.lit(ALLOWED_SET),
            "allowed_keys": F.array(
                F.col("label").cast("string"), F.pmod(F.col("label") + 1, F.lit(10)).cast("string")
            ),
        }
    )


def noul2(spark, folder, *, soft: bool = False) -> DataFrame:
    """Two true/false questions per labelled document; record weight 1 + doc_id mod 3."""
    rows = (
        table(spark, folder, "documents")
        .select("doc_id", "n_chars", "lang", "source")
        .join(table(spark, folder, "labels"), "doc_id")
    )
    x = (F.pmod(F.col("n_chars"), F.lit(17)) - 8) / 4.0
    p = F.col("p") * 0.8 + 0.1 if soft else F.col("p")
    return (
        rows.select(
            F.col("doc_id").alias("id"), "n_chars", "lang", "source",
            (F.lit(1.0) + F.pmod("doc_id", F.lit(3))).alias("record_weight"),
            F.explode(
                F.array(
                    F.struct(F.lit("quality").alias("qid"), F.col("quality").alias("y"),
                             F.lit(2.0).alias("question_weight")),
                    F.struct(F.lit("toxic").alias("qid"), F.col("toxic").alias("y"),
                             F.lit(1.0).alias("question_weight")),
                )
            ).alias("q"),
        )
        .select("*", "q.*")
        .withColumn("p", F.col("y").cast("double"))
        .select(
            "id", "qid", "n_chars", "lang", "source", "record_weight", "question_weight",
            F.lit(BOOLEAN).alias("type"), F.lit(BERNOULLI).alias("kind"),
            names(["true", "false"]).alias("keys"), p.alias("p_true"),
            F.array(F.when(F.col("qid") == "quality", x).otherwise(-x), F.lit(0.0)).alias("logits"),
        )
    )


def score5(spark, folder) -> DataFrame:
    """Order priority as a five-level score."""
    level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    base = (F.col("o_totalprice") / 100000.0) - F.pmod("o_orderkey", F.lit(5))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("priority").alias("qid"),
        F.lit(SCORE).alias("type"), F.lit(CLASS).alias("kind"),
        names(DIGITS[:5]).alias("keys"), level.cast("string").alias("value"),
        level.alias("level"), F.lit(1.0).alias("weight"), "o_orderpriority",
        F.array(
            *[base * (i - 2) / 2.0 - F.pmod(F.col("o_orderkey") + i, F.lit(3)) for i in range(5)]
        ).alias("logits"),
    )


def score10(spark, folder) -> DataFrame:
    """Line-item discount as a ten-level score, the large scoring table."""
    level = F.least(F.lit(9), F.round(F.col("l_discount") * 100).cast("int"))
    return table(spark, folder, "lineitem").select(
        F.lit(SCORE).alias("type"), F.lit(CLASS).alias("kind"), names(DIGITS).alias("keys"),
        level.cast("string").alias("value"), F.lit(1.0).alias("weight"), "l_returnflag",
        F.array(
            *[
                F.sin(F.col("l_quantity") * (i + 1)) - F.abs(level - i) * 0.25
                for i in range(10)
            ]
        ).alias("logits"),
    )


def event_choice(spark, folder) -> DataFrame:
    """Five-way choice per event; the predicted mass on the mode grows with ``value``."""
    top = F.least(F.lit(0.99), 0.25 + F.col("value") / 700.0)
    mode = F.pmod("user_id", F.lit(5)).cast("int")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.lit("kind").alias("qid"), F.lit(CHOICE).alias("type"),
        F.lit(CLASS).alias("kind"), names(EVENT_TYPES).alias("keys"),
        F.col("event_type").alias("value"),
        (1.0 + F.pmod("event_id", F.lit(2))).alias("weight"), top.alias("top_score"), "ts",
        "user_id",
        F.array(
            *[F.log(F.when(mode == i, top).otherwise((1 - top) / 4)) for i in range(5)]
        ).alias("logits"),
    )
