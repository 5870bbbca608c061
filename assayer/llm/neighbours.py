"""Approximate nearest neighbours by learned partitions.

A bounded sample gets its exact neighbour graph, the graph is cut into balanced parts with few cut edges, and a small classifier
learns to predict a vector's part. The classifier places every vector in its most probable part and routes each query to the
several most probable ones, whose vectors are ranked by their exact distance. How many parts a query visits is fitted on the
sample: as few as keep ``RECALL`` of the sample's neighbours within reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import stored

SAMPLE = 6_000  # vectors that graph, parts and classifier are fitted on, chosen by hash over all
PARTS = 16
DEGREE = 10  # neighbours of a vector in the graph
HIDDEN = 96
STEPS, BATCH, RATE = 600, 256, 0.01
RECALL = 0.95
QUERY_ROWS = 4096  # queries of one comparison block
VECTOR_ROWS = 20_000  # vectors of one comparison block


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and squared distances of all vectors at least as near as each query's (k+1)-th, which may be the query itself.
    Distances are found by products first, with a margin for rounding, and exactly for what is within it."""
    out = []
    norms = np.einsum("ij,ij->i", vectors, vectors)
    scale = float(norms.max(initial=0.0))
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        own = np.einsum("ij,ij->i", q, q)
        rough = norms[None, :] - 2 * (q @ vectors.T)
        for i in range(len(q)):
            row = rough[i]
            m = min(len(row), k + 1)  # one more: the query itself may be among them
            limit = np.partition(row, m - 1)[m - 1] + 1e-9 * (scale + own[i]) if m else 0.0
            near = np.flatnonzero(row <= limit)
            gap = vectors[near] - q[i]
            out.append((near, np.einsum("ij,ij->i", gap, gap)))
    return out


def graph(vectors: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """n x degree places of the nearest other vectors."""
    rows = []
    for i, (near, gap) in enumerate(nearest(vectors, vectors, degree)):
        order = [j for j in near[np.lexsort((near, gap))].tolist() if j != i][:degree]
        rows.append(order + [i] * (degree - len(order)))
    return np.array(rows, dtype=np.int64).reshape(-1, degree)


def cut(near: np.ndarray, parts: int, seed: int = 1, sweeps: int = 12) -> np.ndarray:
    """Balanced parts of a neighbour graph.

    Parts grow by breadth from random seeds up to an equal size; then vertices move to the part that holds most of their
    neighbours, largest gain first, as long as no part leaves 95 to 105 % of the mean size.
    """
    n, rng = len(near), np.random.default_rng(seed)
    size = -(-n // parts)
    part = np.full(n, -1, dtype=np.int64)
    order = rng.permutation(n)
    for p in range(parts):
        free = order[part[order] < 0]
        queue, taken = list(free[:1]), 0
        at = 0
        while taken < size and len(free):
            if at == len(queue):
                free = free[part[free] < 0]
                if not len(free):
                    break
                queue.append(free[0])
            v = queue[at]
            at += 1
            if part[v] >= 0:
                continue
            part[v] = p
            taken += 1
            queue.extend(w for w in near[v] if part[w] < 0)
    low, high = int(0.95 * n / parts), int(np.ceil(1.05 * n / parts))
    pairs = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    other = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    for _ in range(sweeps):
        votes = np.zeros((n, parts))
        np.add.at(votes, (pairs, part[other]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        counts = np.bincount(part, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if counts[best[v]] < high and counts[part[v]] > low and rng.random() < 0.8:
                counts[part[v]] -= 1
                counts[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer; ``mean`` and ``scale`` standardize the vectors."""

    mean: np.ndarray
    scale: float
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int = 1

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.first + self.first_bias, 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.second + self.second_bias

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(axis=1)

    def routes(self, x: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Vector and part of every visit: the ``probes`` most probable parts, and further ones until the parts hold ``least`` candidates by ``sizes``."""
        order = np.argsort(-self.scores(x), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        wanted = (np.arange(order.shape[1]) < self.probes) | (before < least)
        row, place = np.nonzero(wanted)
        return row, order[row, place]


def train(vectors: np.ndarray, targets: np.ndarray, hidden: int = HIDDEN, seed: int = 2) -> Router:
    """Adam on the cross entropy against the shares of each vector's neighbourhood in the parts."""
    rng = np.random.default_rng(seed)
    d, m = vectors.shape[1], targets.shape[1]
    net = Router(vectors.mean(axis=0), float(vectors.std()) or 1.0, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, m)), np.zeros(m))
    weights = [net.first, net.first_bias, net.second, net.second_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(vectors), BATCH)
        x = (vectors[pick] - net.mean) / net.scale
        h = np.maximum(x @ net.first + net.first_bias, 0)
        s = h @ net.second + net.second_bias
        s = np.exp(s - s.max(axis=1, keepdims=True))
        error = (s / s.sum(axis=1, keepdims=True) - targets[pick]) / BATCH
        back = (error @ net.second.T) * (h > 0)
        for w, g, (a, b) in zip(weights, (x.T @ back, back.sum(0), h.T @ error, error.sum(0)), moments):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= RATE * (1 - step / (STEPS + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def fit(vectors: np.ndarray, parts: int = PARTS) -> Router:
    """Graph, parts, classifier and number of probes for a sample of vectors. Every fourth vector is kept from the training, and the probes are fitted on those."""
    parts = max(1, min(parts, len(vectors) // (2 * DEGREE)))
    held = np.arange(len(vectors)) % 4 == 3 if len(vectors) >= 16 * DEGREE else np.ones(len(vectors), dtype=bool)
    seen = vectors if held.all() else vectors[~held]
    near = graph(seen)
    part = cut(near, parts)
    targets = np.zeros((len(seen), parts))
    np.add.at(targets, (np.repeat(np.arange(len(seen)), DEGREE), part[near.ravel()]), 0.5 / DEGREE)
    targets[np.arange(len(seen)), part] += 0.5
    net = train(seen, targets)
    # probes: the rank, among a query's parts, of the part that each of its neighbours is placed in
    near = near if held.all() else graph(vectors)[held]
    own = net.place(vectors)
    rank = np.argsort(np.argsort(-net.scores(vectors[held]), axis=1, kind="stable"), axis=1)
    reach = np.sort(rank[np.repeat(np.arange(int(held.sum())), DEGREE), own[near.ravel()]])
    net.probes = int(reach[min(len(reach) - 1, int(np.ceil(RECALL * len(reach))))]) + 1 if len(reach) else 1
    return net


def usable(rows: DataFrame) -> DataFrame:
    """Rows ``vec_id, v`` whose vector is not null, not zero, and without null or non-finite components, of the most frequent length."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    out = out.where(~bad & F.exists("v", lambda x: x != 0))
    lengths = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return out.where(F.size("v") == (lengths[0].n if lengths else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(rows: DataFrame, queries: DataFrame, *, k: int = 10, parts: int = PARTS, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query by Euclidean distance, ties to the smaller id.

    Both tables have ``vec_id`` and ``embedding``. Candidates with the query's own id are left out; rows that repeat an id count once, with
    their smallest distance. Null or zero vectors, and those with null or non-finite components or not of the most frequent length, take no part;
    nor do null ids. A query has fewer rows only where there are fewer candidates; one that finds nothing has no row, so an empty table gives none. Every usable
    row is indexed.
    """
    spark = rows.sparkSession
    base = usable(rows)
    total = base.count()
    order = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30))
    drawn = base.where(order < min(1 << 30, int((1 << 30) * 0.95 * sample / max(1, total)) + (1 << 30) // max(1, total)))
    drawn = drawn.select(order.alias("o"), "vec_id", "v").limit(sample).toArrow()  # bounded by ``sample``
    got = _matrix(drawn.column("v").combine_chunks())
    if not len(got):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    got = got[np.lexsort((drawn.column("vec_id").to_numpy(), drawn.column("o").to_numpy()))]
    net = fit(got, parts)
    shared = spark.sparkContext.broadcast(net)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = shared.value.place(_matrix(batch.column("v"))) if len(batch) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(part.astype(np.int32))], ["vec_id", "v", "part"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, part = shared.value.routes(_matrix(batch.column("v")), held, least) if len(batch) else (np.zeros(0, int), np.zeros(0, int))
            take = pa.array(row)
            columns = [batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "part"])

    kind = "vec_id long, v array<double>, part int"
    index = stored(base.mapInArrow(placed, kind), "placed")
    # ids per part; one that lies in several parts must not be counted on twice, and a query's own id is no candidate
    distinct = {r.part: r.n for r in index.groupBy("part").agg(F.count_distinct("vec_id").alias("n")).collect()}  # one row per part
    held = np.array([distinct.get(p, 0) for p in range(net.second.shape[1])], dtype=np.int64)
    least = k + 1 + int(held.sum()) - index.select("vec_id").distinct().count()
    asked = stored(usable(queries).where(F.size("v") == got.shape[1]).mapInArrow(routed, kind), "routed")
    # Blocks of bounded size: a part's vectors and its queries are each dealt out by hash, every pair of blocks meets once.
    sizes = index.groupBy("part").agg(F.count("*").alias("n")).withColumn("vs", F.ceil(F.col("n") / VECTOR_ROWS).cast("int"))
    many = asked.groupBy("part").agg(F.count("*").alias("m")).withColumn("qs", F.ceil(F.col("m") / QUERY_ROWS).cast("int"))
    grid = F.broadcast(sizes.join(many, "part").select("part", "vs", "qs"))  # one row per part
    left = index.join(grid, "part").withColumn("vb", F.pmod(F.xxhash64("vec_id", "v"), F.col("vs")).cast("int"))
    left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select("part", "vb", "qb", "vec_id", "v")
    right = asked.join(grid, "part").withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.col("qs")).cast("int"))
    right = right.withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vs") - 1))).select("part", "vb", "qb", "vec_id", "v")

    def rank(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, names = vectors.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        x, q = (_matrix(t.column("v").combine_chunks()) for t in (vectors, queries))
        who, which, far = [], [], []
        if len(ids) and len(names):
            extra = int(np.unique(ids, return_counts=True)[1].max())  # rows that repeat an id must not crowd out others
            for name, (near, gap) in zip(names, nearest(q, x, (k + 1) * extra)):
                other = near[ids[near] != name]
                found, gap = ids[other], gap[ids[near] != name]
                order = np.lexsort((found, gap))
                first = np.sort(np.unique(found[order], return_index=True)[1])[:k]
                which.append(found[order][first]), far.append(np.sqrt(gap[order][first]))
                who.append(np.full(len(first), name))
        join = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
        return pa.table({"query_id": join(who, np.int64), "vec_id": join(which, np.int64), "score": join(far, np.float64)})

    keys = ["part", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.expr("row_number() over (partition by query_id order by score, vec_id)")
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
