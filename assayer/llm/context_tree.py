"""Language-model scores by context-tree weighting over bytes.

Every byte is decomposed into eight binary decisions. Each decision has a context tree over the bytes before it, up to ``DEPTH`` of
them (zeros before a text begins), and a node's Krichevsky-Trofimov estimate is mixed with those of all depths below it by
the tree's weights. The weights follow from the counts of the training texts alone. The upper levels of the trees are tables, built one
after another: sums per parent going up, mixtures going down. What lies below a context of the last such level is worked out in
one task. A text's score is the sum of its bytes' log probabilities.

Tables of counts and probabilities cover all texts and grow with them. The entries that occur most are sent to every task, up to ``SENT`` of both
kinds, words first and at most half of them; what they do not cover is joined exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import text as tx
from assayer.llm.shared import discard, stored

DEPTH = 6  # at most 7: a context and its byte are packed into 64 bits
CUT = 3  # context bytes of the upper levels, more where over GROUP_GRAMS distinct contexts end in the same bytes
GROUP_GRAMS = 1 << 20
TASK_GRAMS = 1 << 18  # distinct contexts with their byte that a task is dealt on average
SENT = 1 << 21  # entries of the word table and of the byte table that tasks look up themselves; about 40 bytes each
LISTED = 1 << 16  # entries of one list of a text's words or bytes that are left to be joined
HELD = 1 << 19  # distinct keys that a task sums up before it hands them on
WORD, GRAM = 0, 1
END = -1  # key of the end token among the words


def grams(data: np.ndarray, off: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Begin of each block of bytes, and for each byte its context and itself packed into one number, itself lowest."""
    lower = tx.LOWER[data]
    for a in range(0, len(data), tx.BLOCK):
        b, lo = min(len(data), a + tx.BLOCK), max(0, a - depth)
        part = lower[lo:b]
        starts = off[np.searchsorted(off, lo, "left") : np.searchsorted(off, b, "left")]
        ends = off[np.minimum(np.searchsorted(off, starts, "right"), len(off) - 1)]
        out = part.astype(np.uint64)
        for k in range(1, depth + 1):
            before = np.zeros(len(part), dtype=np.uint64)
            before[k:] = part[:-k]
            for i in range(k):
                at = (starts + i)[starts + i < np.minimum(ends, b)] - lo
                before[at] = 0
            out |= before << tx.U64(8 * k)
        yield a, out[a - lo :]


def counts(docs: DataFrame, depth: int) -> DataFrame:
    """``kind, key, n``: training count of every word of the training texts and of every byte in context of all texts.

    ``docs`` has ``text`` and the boolean ``train``. A task sums up what it reads before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {WORD: [], GRAM: []}
        sizes = {WORD: 0, GRAM: 0}
        ends = 0

        def add(kind: int, keys: np.ndarray, weight: np.ndarray) -> None:
            code, distinct = pd.factorize(keys)
            parts[kind].append((distinct, np.bincount(code, weights=weight, minlength=len(distinct)).astype(np.int64)))
            sizes[kind] += len(distinct)

        def merged(kind: int) -> None:
            keys = np.concatenate([p[0] for p in parts[kind]])
            n = np.concatenate([p[1] for p in parts[kind]])
            parts[kind], sizes[kind] = [], 0
            add(kind, keys, n)

        def out(kind: int) -> pa.RecordBatch:
            keys, n = parts[kind][0]
            parts[kind], sizes[kind] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(n)], ["kind", "key", "n"]
            )

        for batch in tx.portions(batches):
            train = batch.column("train").to_numpy(zero_copy_only=False)
            data, off = tx.texts(batch.column("text"))
            ends += int(train.sum())
            words, rows = tx.words(data, off)
            keep = train[rows]
            if keep.any():
                add(WORD, words[keep], np.ones(int(keep.sum())))
            flag = np.repeat(train, np.diff(off))
            for at, found in grams(data, off, depth):
                add(GRAM, found, flag[at : at + len(found)].astype(float))
            for kind in (WORD, GRAM):
                if sizes[kind] > 2 * HELD:
                    merged(kind)
                    if sizes[kind] > HELD:
                        yield out(kind)
        for kind in (WORD, GRAM):
            if parts[kind]:
                merged(kind)
                yield out(kind)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([WORD], pa.int32()), pa.array([END], pa.int64()), pa.array([ends], pa.int64())], ["kind", "key", "n"])

    rows = docs.select("train", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tx.tidied(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x, log=F.log):
    """Of columns, or arrays with their ``log``. For x >= 0.5, by Stirling's series at x + 8; the error is below 1e-12."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(product)


def _level(df: DataFrame, leaf: bool) -> DataFrame:
    """Adds ``pe`` (log estimate), ``pw`` (log weighted probability), ``w`` (weight of the own estimate) and ``kt`` (its probability of 1)."""
    a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
    out = df.withColumn("pe", _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi))
    out = out.withColumn("pe", F.when(a + b == 0, 0.0).otherwise(F.col("pe")))
    pe, below = F.col("pe"), F.col("below")
    if leaf:
        out = out.withColumn("pw", pe).withColumn("w", F.lit(1.0))
    else:
        out = out.withColumn("pw", F.greatest(pe, below) + F.log1p(F.exp(-F.abs(pe - below))) - math.log(2))
        out = out.withColumn("w", 1 / (1 + F.exp(F.least(below - pe, F.lit(700.0)))))
    return out.withColumn("kt", (b + 0.5) / (a + b + 1))


def subtrees(keys: np.ndarray, n: np.ndarray, depth: int, cut: int) -> Iterator[tuple]:
    """For each of a byte's eight places: the nodes at depth ``cut`` with ``n0, n1, below``, and a function from their ``sum`` and
    ``rest`` to log10 probabilities by key. ``keys`` hold whole subtrees of nodes at depth ``cut``."""
    byte, context = keys & tx.U64(255), keys >> tx.U64(8)
    order = np.zeros(len(keys), dtype=tx.U64)  # newest byte highest, so that the contexts that share newest bytes are neighbours
    for i in range(depth):
        order = (order << tx.U64(8)) | ((context >> tx.U64(8 * i)) & tx.U64(255))
    for k in range(8):
        prefix = byte >> tx.U64(8 - k)
        place = (prefix << tx.U64(8 * depth)) | order
        sort = np.argsort(place)
        ids, one = place[sort], ((byte[sort] >> tx.U64(7 - k)) & tx.U64(1)).astype(bool)
        sums = [np.where(one, 0, n[sort]), np.where(one, n[sort], 0), np.zeros(len(keys))]
        steps = []
        for d in range(depth, cut - 1, -1):
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            parent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            ids, (n0, n1, below) = ids[first], (np.add.reduceat(x, first) for x in sums)
            if d == depth:
                leader = sort[first]
            else:
                leader = leader[first]
            if d > cut:
                pe = _log_gamma(n0 + 0.5, np.log) + _log_gamma(n1 + 0.5, np.log) - _log_gamma(n0 + n1 + 1.0, np.log) - math.log(math.pi)
                pe[n0 + n1 == 0] = 0.0
                pw, w = pe, np.ones(len(pe))
                if d < depth:
                    pw, w = np.logaddexp(pe, below) - math.log(2), 1 / (1 + np.exp(np.minimum(below - pe, 700.0)))
                steps.append((parent, w, (n1 + 0.5) / (n0 + n1 + 1)))
                sums, ids = [n0, n1, pw], ids >> tx.U64(8)
        nodes = ((context[leader] & tx.U64((1 << 8 * cut) - 1)) << tx.U64(8)) | tx.U64(1 << k) | prefix[leader]

        def down(total, rest, steps=steps, at=parent, sort=sort, one=one):
            for parent, w, kt in reversed(steps):
                total, rest = total[at], rest[at]
                total, rest, at = total + rest * w * kt, rest * (1 - w), parent
            total = total[at]
            out = np.empty(len(sort))
            out[sort] = np.log10(np.where(one, total, 1 - total))
            return out

        yield nodes.view(np.int64), n0, n1, below, down


def _ending(cut: int) -> Column:
    """The newest ``cut`` bytes of a key's context."""
    return F.expr(f"shiftright(key, 8) & {(1 << 8 * cut) - 1}L")


def _up(depth: int, cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches if len(b)]
        if parts:
            keys, n = (np.concatenate(x) for x in zip(*parts))
            for nodes, n0, n1, below, _ in subtrees(keys.view(tx.U64), n, depth, cut):
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n0), pa.array(n1), pa.array(below)], ["node", "n0", "n1", "below"])

    return tx.tidied(run)


def _down(depth: int, cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_, mixed = [], []
        for b in batches:
            key, n, total, rest = (b.column(c).to_numpy() for c in ("key", "n", "sum", "rest"))
            node = n < 0
            grams_.append((key[~node], n[~node])), mixed.append((key[node], total[node], rest[node]))
        keys, n = (np.concatenate(x) for x in zip(*grams_)) if grams_ else (np.zeros(0, np.int64),) * 2
        if not len(keys):
            return
        known, total, rest = (np.concatenate(x) for x in zip(*mixed))
        sort = np.argsort(known)
        value = np.zeros(len(keys))
        for nodes, _, _, _, down in subtrees(keys.view(tx.U64), n, depth, cut):
            at = sort[np.searchsorted(known, nodes, sorter=sort)]
            value += down(total[at], rest[at])
        for a in range(0, len(keys), tx.BLOCK):
            b = a + tx.BLOCK
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(n[a:b]), pa.array(value[a:b])], ["key", "n", "value"])

    return tx.tidied(run)


def probabilities(found: DataFrame, depth: int, made: list[str]) -> DataFrame:
    """``key, n, value``: log10 probability of each byte in context, for ``found`` with ``key`` and training count ``n``. ``made`` collects what is written on the way.

    Nodes of the upper levels are numbered by context (newest byte lowest), then eight bits for the place in the byte's binary decomposition.
    """
    for cut in range(min(CUT, depth), depth + 1):
        most, total = found.groupBy(_ending(cut).alias("ending")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (most or 0) <= GROUP_GRAMS:
            break
    tasks = max(1, -(-(total or 0) // TASK_GRAMS))
    nodes = found.repartition(tasks, _ending(cut)).mapInArrow(_up(depth, cut), "node long, n0 long, n1 long, below double")
    levels = [stored(_level(nodes, cut == depth), f"level-{cut}", made)]
    for d in range(cut - 1, -1, -1):
        parent = F.expr(f"node & {(1 << 8 * (d + 1)) - 1}L").alias("node")
        up = levels[0].groupBy(parent).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        levels.insert(0, stored(_level(up, False), f"level-{d}", made))
    mixed = levels[0].select("node", (F.col("w") * F.col("kt")).alias("sum"), (1 - F.col("w")).alias("rest"))
    for d in range(1, cut + 1):
        above = mixed.select(F.col("node").alias("parent"), "sum", "rest")
        down = levels[d].withColumn("parent", F.expr(f"node & {(1 << 8 * d) - 1}L")).join(above, "parent")
        mixed = down.select("node", (F.col("sum") + F.col("rest") * F.col("w") * F.col("kt")).alias("sum"), (F.col("rest") * (1 - F.col("w"))).alias("rest"))
        mixed = stored(mixed, f"mixed-{d}", made)
    # A node has its context where a key has it, and goes to the task of its keys.
    none = F.lit(0.0)
    rows = found.select("key", "n", none.alias("sum"), none.alias("rest")).union(mixed.select("node", F.lit(-1).cast("long"), "sum", "rest"))
    return rows.repartition(tasks, _ending(cut)).mapInArrow(_down(depth, cut), "key long, n long, value double")


def _most(table: DataFrame, limit: int) -> tuple[pa.Table, bool]:
    """The entries with the largest ``n``, at most ``limit`` of them, and whether that is all. Cut between eighths of powers of two."""
    band = F.floor(8 * F.log2(F.col("n") + 1))
    sizes = sorted(((r[0], r[1]) for r in table.groupBy(band.alias("band")).count().collect()), reverse=True)
    total, least = 0, None
    for b, n in sizes:
        if total + n > limit:
            break
        total, least = total + n, b
    got = table.where(band >= least) if least is not None else table.limit(0)
    return got.toArrow(), total == sum(n for _, n in sizes)


def _lists(rest: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[tuple]:
    """Row, kind and size of every list of at most LISTED distinct keys, all keys, and how often their row holds each."""
    for rows, keys, kind in rest:
        if len(rows):
            code, names = pd.factorize(keys)
            pair, many = np.unique(rows.astype(np.int64) * len(names) + code, return_counts=True)
            row, at = pair // len(names), np.arange(len(pair))
            begin = np.flatnonzero((at - np.searchsorted(row, row)) % LISTED == 0)
            yield row[begin], np.full(len(begin), kind), np.diff(np.append(begin, len(pair))), names[pair % len(names)].view(np.int64), many


def score(docs: DataFrame, train: Column, keep: list[str], *, depth: int = DEPTH) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``.

    A-Z are lower-cased throughout. Tokens are words and one end per text. ``base_score`` is the add-one word model:
    the sum over tokens of log10((c + 1) / (N + V + 1)). ``score`` is the context-tree model's log10 probability of the text's bytes,
    ``bits_per_byte`` its code length (null for a text without bytes). A null text is empty: one end token, score 0. Repeated rows each
    get a row, and each counts in training. Without training rows every bit has probability 1/2. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = stored(counts(docs.select(F.coalesce(train, F.lit(False)).alias("train"), "text"), depth), "counts")
    words = table.where(F.col("kind") == WORD).select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train, distinct = int(total[0]), int(total[1])
    words = words.select("key", "n", F.log10(F.col("n") + 1).alias("value"))
    found = table.where(F.col("kind") == GRAM).select("key", "n")
    made: list[str] = []
    bytes_ = stored(probabilities(found, depth, made), "bytes")
    discard(spark, made)
    sent = []
    for part, limit in ((words, lambda: SENT // 2), (bytes_, lambda: SENT - len(sent[0][0]))):
        got, whole = _most(part, limit())
        sent.append((got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy(), whole))
    shared = spark.sparkContext.broadcast(sent)
    base = math.log10(n_train + distinct + 1)

    def look_up():
        return [(tx.HashIndex(keys), np.append(value, 0.0), whole) for keys, value, whole in shared.value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word_index, word_value, all_words), (byte_index, byte_value, all_bytes) = look_up()
        for batch in tx.portions(batches):
            data, off = tx.texts(batch.column("text"))
            n = len(batch)
            rest: list[tuple[np.ndarray, np.ndarray, int]] = []
            hashes, rows = tx.words(data, off)
            ends = np.arange(n, dtype=np.int32)
            keys, rows = np.concatenate([hashes, np.full(n, END).astype(np.int64).view(np.uint64)]), np.concatenate([rows, ends])
            at = word_index.find(keys)
            tokens = np.bincount(rows, minlength=n)
            known = np.bincount(rows[at >= 0], minlength=n)
            words_sum = np.bincount(rows, weights=word_value[at], minlength=n)
            if not all_words:
                rest.append((rows[at < 0], keys[at < 0], WORD))
            bytes_sum = np.zeros(n)
            owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
            for begin, packed in grams(data, off, depth):
                at = byte_index.find(packed)
                own = owner[begin : begin + len(packed)]
                bytes_sum += np.bincount(own, weights=byte_value[at], minlength=n)
                if not all_bytes:
                    rest.append((own[at < 0], packed[at < 0], GRAM))
            row, kind, size = [np.arange(n)], [np.full(n, -1)], [np.zeros(n, np.int64)]
            key, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for parts in _lists(rest):
                for column, part in zip((row, kind, size, key, many), parts):
                    column.append(part)
            row, kind, size, key, many = (np.concatenate(x) for x in (row, kind, size, key, many))
            first = kind < 0
            places = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            listed = lambda x: pa.ListArray.from_arrays(places, pa.array(x))
            pick = lambda x: pa.array(np.where(first, x[row], 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(row)), batch.column("id").take(pa.array(row)), pa.array(kind.astype(np.int32)), listed(key), listed(many), pick(tokens.astype(np.int64)), pick(known.astype(np.int64)), pick(words_sum), pick(bytes_sum), pick(np.diff(off).astype(np.int64))],
                ["row", "id", "kind", "key", "many", "tokens", "known", "words", "bytes", "n_bytes"],
            )

    number = lambda name, kind: T.StructField(name, kind())
    identity = F.struct("doc_id", F.xxhash64("text").alias("th")).alias("id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), identity, F.col("text").cast("string").alias("text"))
    kind = T.StructType(
        [rows.schema["row"], rows.schema["id"], number("kind", T.IntegerType)]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("key", "many")] + [number(c, T.LongType) for c in ("tokens", "known")] + [number(c, T.DoubleType) for c in ("words", "bytes")] + [number("n_bytes", T.LongType)]
    )
    passed = stored(rows.mapInArrow(tx.tidied(run), kind), "scored")
    number_of = F.xxhash64("id.doc_id", "id.th")
    whole = passed.where("kind < 0")
    # texts go by a short number where no two share one, and need no grouping where no row repeats
    facts = whole.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(number_of).alias("numbers")).first()
    name = number_of if facts.ids == facts.numbers else F.col("id")
    whole = whole.withColumn("ref", name)
    joined = whole
    for what, part, (*_, all_sent) in ((WORD, words, sent[0]), (GRAM, bytes_, sent[1])):
        names = [f"{c}_{what}" for c in ("held", "sum")]
        if all_sent:
            joined = joined.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(0.0)})
            continue
        rest = passed.where(F.col("kind") == what).select(name.alias("ref"), F.inline(F.arrays_zip("key", "many")))
        if facts.n > facts.ids:
            rest = rest.groupBy("ref", "key").agg(F.max("many").alias("many"))  # repeated rows have the same
        # a task's share of the table is far smaller than that of the texts, which need no sorting then
        found = rest.join(part.select("key", "value").hint("shuffle_hash"), "key", "left")
        held = F.sum(F.when(F.col("value").isNotNull(), F.col("many")))
        added = found.groupBy("ref").agg(held.alias(names[0]), F.sum(F.col("many") * F.coalesce("value", F.lit(0.0))).alias(names[1]))
        joined = joined.join(added, "ref", "left")
    plus = lambda c: F.coalesce(c, F.lit(0))
    value = F.col("bytes") + plus(f"sum_{GRAM}")
    return joined.select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("tokens").alias("n_tokens"), (F.col("known") + plus(f"held_{WORD}")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("words") + plus(f"sum_{WORD}") - F.col("tokens") * base).alias("base_score"),
        value.alias("score"), "n_bytes", F.when(F.col("n_bytes") > 0, -value / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
    )
