"""Token layouts of requests: costs, budgets, marker safety and reordering of stored options.

A tokenizer is any function Column -> ARRAY<INT> column, so a pandas UDF around an external tokenizer
plugs in directly; ``word_tokens`` is a built-in one for tests and examples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.constants import SCORE
from assayer.functions import json as J
from assayer.operators.skew import fan_out_join

INTS = "array<int>"
Tokenizer = Callable[[Column], Column]

# Ids of the built-in tokenizer: controls, markers, bytes, then hashed words.
BOS, EOS, CANDIDATE_END, DECISION_END, BYTE_BASE, WORD_BASE, VOCABULARY = 2, 1, 6, 7, 256, 1024, 250_000
WORD = r"<unused[01]>|[A-Za-z0-9À-ɏ]+|[^ \t\r\nA-Za-z0-9À-ɏ]"
SPELLINGS = {"<unused0>": CANDIDATE_END, "<unused1>": DECISION_END}


@dataclass(frozen=True)
class Layout:
    """Marker and control ids, budgets and the tokenizer of one compiler."""

    tokenizer: Tokenizer
    bos: int = BOS
    eos: int = EOS
    candidate_end: int = CANDIDATE_END
    decision_end: int = DECISION_END
    max_sequence: int = 32_768
    max_request: int = 64_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_id(word: Column) -> Column:
    special = F.create_map(*[F.lit(x) for item in SPELLINGS.items() for x in item])
    hashed = F.pmod(F.xxhash64(word), F.lit(VOCABULARY - WORD_BASE)).cast("int") + WORD_BASE
    return F.coalesce(F.try_element_at(special, word), hashed)


def byte_ids(text: Column, base: int = BYTE_BASE) -> Column:
    """One id per UTF-8 byte."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"))
    return F.transform(pairs, lambda h: (F.conv(h, 16, 10).cast("int") + base))


def guarded(words: Column, protected: dict[str, int] = SPELLINGS) -> Column:
    """Token ids in which a protected spelling becomes the bytes of its text, so no text can carry
    a marker id."""
    names = F.array(*[F.lit(k) for k in protected])
    return F.flatten(
        F.transform(
            words,
            lambda w: F.when(F.array_contains(names, w), byte_ids(w)).otherwise(F.array(word_id(w))),
        )
    ).cast(INTS)


def word_tokens(text: Column) -> Column:
    return guarded(words_of(text))


def marker_forgeries(tokens: Column, marker: int, positions: Column) -> Column:
    """True when the marker id occurs anywhere but at the compiler's own positions."""
    found = F.filter(
        F.transform(tokens, lambda t, i: F.when(t == marker, i)), lambda i: i.isNotNull()
    )
    return found != positions.cast(INTS)


def candidate_texts(q: Column) -> Column:
    """One text per option, naming it with its description."""
    boolean = lambda k: F.get(q["descriptions"], F.array_position(q["criteria_keys"], k).cast("int") - 1)
    texts = F.transform(
        q["keys"],
        lambda k, i: F.concat(
            F.lit('candidate: {"name":'), J.quote(k), F.lit(',"description":'),
            F.coalesce(
                F.when(q["type"] == SCORE, F.get(q["descriptions"], i)).otherwise(boolean(k)), F.lit("null")
            ),
            F.lit("}"),
        ),
    )
    return texts


def question_layout(questions: DataFrame, layout: Layout, q: str = "question") -> DataFrame:
    """Add ``tokens``, ``candidate_positions``, ``candidate_starts``, ``decision_position`` and
    ``instruction_tokens`` for a question struct column."""
    enc, col = layout.tokenizer, F.col(q)
    df = questions.withColumns(
        {
            "__head": F.concat(
                F.array(F.lit(layout.bos)),
                enc(F.concat(F.lit("type: "), col["type"], F.lit("\n"))),
                F.when(
                    col["instructions_json"].isNotNull(),
                    enc(F.concat(F.lit("instructions: "), col["instructions_json"], F.lit("\n"))),
                ).otherwise(F.array().cast(INTS)),
            ),
            "__texts": candidate_texts(col),
            "__break": enc(F.lit("\n")),
            "instruction_tokens": F.when(
                col["instructions_json"].isNotNull(), F.size(enc(col["instructions_json"]))
            ).otherwise(0),
        }
    )
    # Explode-free encoding of the options: one tokenizer call per option text.
    df = df.withColumn("__options", F.transform("__texts", enc))
    chunk = F.transform(
        "__options", lambda o: F.concat(o, F.array(F.lit(layout.candidate_end)), F.col("__break"))
    )
    df = df.withColumn("__chunks", chunk)
    before = lambda i: F.aggregate(
        F.slice("__chunks", F.lit(1), i), F.lit(0), lambda s, c: s + F.size(c)
    )
    df = df.withColumn(
        "candidate_starts", F.transform("__chunks", lambda _c, i: F.size("__head") + before(i))
    )
    body = F.concat("__head", F.flatten("__chunks"))
    return df.withColumns(
        {
            "candidate_positions": F.zip_with("candidate_starts", "__options", lambda s, o: s + F.size(o)),
            "decision_position": F.size(body),
            "tokens": F.concat(body, F.array(F.lit(layout.decision_end))),
        }
    ).drop("__head", "__texts", "__break", "__options", "__chunks")


def per_distinct(questions: DataFrame, work: Callable[[DataFrame], DataFrame], text: str, row_key: Column, q: str = "question", **options) -> DataFrame:
    """Do ``work`` once on each distinct question (rows with ``question_sha``, ``n`` and the question) and join its columns back. A template that holds a large share of
    the rows is split over several tasks on the way back."""
    keyed = questions.withColumn("question_sha", F.sha2(F.col(text), 256))
    distinct = keyed.groupBy("question_sha").agg(F.any_value(q).alias(q), F.count(F.lit(1)).alias("n"))
    counts = keyed.groupBy("question_sha").agg(F.count(F.lit(1)).alias("n"))
    return fan_out_join(keyed, work(distinct).drop(q), "question_sha", row_key, counts=counts, **options).drop("question_sha", "n")


def compile_distinct(questions: DataFrame, layout: Layout, text: str, row_key: Column, q: str = "question", **options) -> DataFrame:
    """Lay out each distinct question once and join it back."""
    return per_distinct(questions, lambda distinct: question_layout(distinct, layout, q), text, row_key, q, **options)


def preface(instructions: Column) -> Column:
    """Distinct non-blank instruction texts in request order, as one block; NULL when there is none."""
    kept = F.array_distinct(F.filter(instructions, lambda t: F.trim(t) != ""))
    return F.when(
        F.size(kept) > 0, F.concat(F.lit("\n\nquestions: "), F.to_json(kept))
    )


def state_tokens(df: DataFrame, layout: Layout, *, longest: str, asked: str, with_preface: str | None = None) -> DataFrame:
    """Add ``state_tokens`` and ``has_preface``. The preface is dropped when the request would no
    longer fit the budgets with it."""
    enc = layout.tokenizer
    df = df.withColumn("__body", F.size(enc(F.col("state_json"))) + 2)
    if with_preface is None:
        return df.withColumns({"state_tokens": F.col("__body"), "has_preface": F.lit(False)}).drop("__body")
    df = df.withColumn("__aware", F.col("__body") + F.size(enc(F.col(with_preface))))
    fits = (
        F.col(with_preface).isNotNull()
        & (F.col("__aware") + F.col(longest) <= layout.max_sequence)
        & (F.col("__aware") + F.col(asked) <= layout.max_request)
    )
    fits = F.coalesce(fits, F.lit(False))
    return df.withColumns(
        {"state_tokens": F.when(fits, F.col("__aware")).otherwise(F.col("__body")), "has_preface": fits}
    ).drop("__body", "__aware")


def budget_violations(tokens: DataFrame, layout: Layout, key: str = "id") -> DataFrame:
    """Requests over a token budget, from rows of (key, state_tokens, question_tokens). Nothing is
    truncated: a request over budget is rejected whole."""
    per = tokens.groupBy(key).agg(
        F.max("state_tokens").alias("state"), F.max("question_tokens").alias("longest"),
        F.sum("question_tokens").alias("asked"),
    )
    return per.select(
        key,
        F.when(F.col("state") + F.col("longest") > layout.max_sequence, "sequence")
        .when(F.col("state") + F.col("asked") > layout.max_request, "request")
        .alias("budget"),
    ).filter(
        (F.col("state") + F.col("longest") > layout.max_sequence)
        | (F.col("state") + F.col("asked") > layout.max_request)
    )


def pair_costs(base: DataFrame, views: DataFrame, key: str = "id") -> DataFrame:
    """Cost list of each record: the base request, then base plus each view in order, counting an
    equal state once; a view that could not be compiled (NULL tokens) costs the base alone.

    ``base``: (key, state_sha, state_tokens, input_tokens); ``views``: the same plus ``view_index``.
    The number of views of a record is bounded by the record itself.
    """
    v = views.select(
        key, "view_index", F.col("state_sha").alias("v_sha"), F.col("state_tokens").alias("v_state"),
        F.col("input_tokens").alias("v_tokens"),
    )
    shared = F.when(F.col("v_sha") == F.col("state_sha"), F.col("v_state")).otherwise(0)
    cost = F.when(F.col("v_tokens").isNull(), F.col("input_tokens")).otherwise(
        F.col("input_tokens") + F.col("v_tokens") - shared
    )
    one = F.when(F.col("view_index").isNotNull(), F.struct("view_index", cost.alias("cost")))
    return (
        base.join(v, key, "left")
        .groupBy(key)
        .agg(F.any_value("input_tokens").alias("base"), F.array_sort(F.collect_list(one)).alias("v"))
        .select(key, F.concat(F.array("base"), F.transform("v", lambda x: x["cost"])).alias("costs"))
    )


def tokenization_report(costs: DataFrame) -> DataFrame:
    return costs.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.get("costs", F.lit(0))).alias("base_tokens"),
        F.count_if(F.size("costs") > 1).alias("records_with_views"),
    )


def reorder_options(
    tokens: Column, keys: Column, starts: Column, positions: Column, decision: Column, wanted: Column
) -> Column:
    """Stored options in a new order without tokenizing again: STRUCT<tokens, candidate_starts,
    candidate_positions>. Different option sets are an error."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(decision))
    index = F.transform(wanted, lambda k: F.array_position(keys, k).cast("int") - 1)
    same = (F.size(F.array_except(keys, wanted)) == 0) & (F.size(F.array_except(wanted, keys)) == 0)
    length = lambda i: F.get(ends, i) - F.get(starts, i)
    head = F.get(starts, F.lit(0))
    chunks = F.transform(index, lambda i: F.slice(tokens, F.get(starts, i) + 1, length(i)))
    new_starts = F.transform(
        index,
        lambda _x, n: head + F.aggregate(F.slice(index, F.lit(1), n), F.lit(0), lambda s, j: s + length(j)),
    )
    new_positions = F.zip_with(
        new_starts, index, lambda s, i: s + F.get(positions, i) - F.get(starts, i)
    )
    out = F.concat(
        F.slice(tokens, F.lit(1), head), F.flatten(chunks),
        F.slice(tokens, decision + 1, F.size(tokens) - decision),
    )
    built = F.struct(
        out.alias("tokens"), new_starts.alias("candidate_starts"), new_positions.alias("candidate_positions")
    )
    return F.when(same, built).otherwise(F.raise_error("stored candidates differ from the request"))


def stored_violations(df: DataFrame, layout: Layout) -> Column:
    """First broken rule of a stored question: option count, marker ids and positions, budgets."""
    tokens, positions = F.col("tokens"), F.col("candidate_positions")
    decision = F.col("decision_position")
    inside = (decision >= 0) & (decision < F.size(tokens))
    placed = F.forall(
        positions, lambda p: (p >= 0) & (p < decision) & (F.get(tokens, p) == layout.candidate_end)
    )
    return (
        F.when(F.size("keys") != F.size(positions), "count")
        .when(~inside | (F.get(tokens, decision) != layout.decision_end), "decision")
        .when(~placed, "candidates")
        .when(F.col("state_tokens") + F.size(tokens) > layout.max_sequence, "sequence")
    )


def tokens_missing(df: DataFrame) -> DataFrame:
    """Number of rows without stored tokens or costs."""
    return df.agg(
        F.count_if(F.col("_tokenized").isNull() | F.col("_token_costs").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("rows"),
    )
