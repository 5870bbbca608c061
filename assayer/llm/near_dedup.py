"""MinHash near-duplicates by a multi-index Hamming join.

Each document becomes the set of its distinct word shingles. Documents with equal sets form one class, so
copies are never expanded into pairs. A class has a signature of 256 symbols of 16 bits, one per minimum hash. The first 64
symbols are cut into 12 chunks. Two signatures with at most 23 different symbols must have a chunk with at most one
(pigeonhole: 12 x 2 > 23), so every way to leave out one symbol of a chunk is a key, 64 keys per
class, and all pairs under the distance meet under a key. Candidates are confirmed on the full shingle sets, computed again
from the whole texts.

Links are found in two ways. First each class is compared with one hub, the most central member of its keys: the one whose own
keys are shared most, which in a group of varied copies is what they were made from. That joins
large groups by one comparison per member, and is repeated with the next hubs while it pays. Then classes that share a key but lie in
different groups are matched on signatures, inside bounded blocks of a key's members. What is within the distance forms clusters,
of which only spanning edges leave a task; the full shingle sets of a cluster are compared slice by slice, and again only
edges that span the links leave a task. So no stage emits the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import text as tx
from assayer.llm.shared import components, small, stored

SYMBOLS = 256  # of a signature
INDEXED = 64  # of them in the index
MISSED = 1e-5  # chance that a pair at exactly the threshold is further apart than the distance allowed
BLOCK_ROWS = 1024  # members of a key whose signatures one task compares with each other
SLICE_ROWS = 256  # members of a cluster whose shingle sets one task compares with each other
GAIN = 0.2  # share of links among the tried hub pairs that makes another round of hubs worth its jobs
HUB_ROWS = 64  # pairs of a hub that share one copy of its text


def allowed(symbols: int, percent: int, missed: float = MISSED) -> int:
    """Different symbols that pairs at the threshold exceed only with chance ``missed``."""
    p, tail, d = 1 - percent / 100, 1.0, -1
    while tail > missed:
        d += 1
        tail -= comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
    return d


def _sets(data, off, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text. A text shorter than a shingle has its whole word sequence."""
    hashes, rows = tx.words(data, off)
    found, first = tx.shingles(hashes, rows, size)
    n = len(off) - 1
    ends = np.searchsorted(rows, np.arange(n + 1))
    cuts = np.searchsorted(rows[first] if len(first) else first, np.arange(n + 1))
    for i in range(n):
        if cuts[i] < cuts[i + 1]:
            yield np.unique(found[cuts[i] : cuts[i + 1]])
        elif ends[i] < ends[i + 1]:
            own = hashes[ends[i] : ends[i + 1]]
            yield tx.shingles(own, np.zeros(len(own), np.int32), len(own))[0] ^ tx.U64(len(own))
        else:
            yield np.zeros(0, dtype=np.uint64)


_FACTOR = (tx._random(SYMBOLS, 11) >> tx.U64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (tx._random(SYMBOLS, 13) >> tx.U64(32)).astype(np.uint32)


def _signature(found: np.ndarray) -> bytes:
    x = (found >> tx.U64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        part = x[None, at : at + 2048] * _FACTOR[:, None] + _SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, th, n_shingles, node, sig`` per document: the set's size, its 64-bit class and its signature. Both are
    null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.portions(batches, limit=tx.SHORT):
            data, off = tx.texts(batch.column("text"))
            count, node, sig = [], [], []
            for found in _sets(data, off, size):
                count.append(len(found))
                node.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                sig.append(_signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(count, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "th", "n_shingles", "node", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tx.tidied(run), "doc_id long, th long, n_shingles long, node long, sig binary")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), SYMBOLS)


def keys(nodes: DataFrame, percent: int) -> DataFrame:
    """``key, node``: one key for every symbol of a chunk left out."""
    chunks = allowed(INDEXED, percent) // 2 + 1
    bounds = np.linspace(0, INDEXED, chunks + 1).astype(int)
    factor, absent = tx._random(INDEXED, 17) | tx.U64(1), tx._random(INDEXED, 19)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            symbols = _symbols(batch.column("sig"))[:, :INDEXED].astype(np.uint64) + tx.U64(1)
            terms = symbols * factor
            out = np.empty((len(batch), INDEXED), dtype=np.uint64)
            for a, b in zip(bounds, bounds[1:]):
                whole = terms[:, a:b].sum(axis=1, dtype=np.uint64)
                for k in range(a, b):
                    out[:, k] = tx.mix(whole - terms[:, k] + absent[k])
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), INDEXED)
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(tx.tidied(run), "key long, node long")


def _unlike(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different groups so far."""
    roots = small(roots)
    root = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root`` after more links: only the groups that they touch are joined."""
    if roots is None:
        return stored(components(links), "roots")
    roots = small(roots)
    known = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    both = links.join(known("a"), "a", "left").join(known("b"), "b", "left")
    both = stored(both.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct(), "group-links")
    moved = small(stored(components(both).withColumnRenamed("root", "to"), "moved"))
    old = roots.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = moved.join(roots, "node", "left_anti").select("node", F.col("to").alias("root"))
    return stored(old.union(fresh), "roots")


def _apart(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, weight`` within the signature distance and with sizes that allow a link; adds ``apart``."""
    near, far = allowed(INDEXED, percent), allowed(SYMBOLS, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            other = _symbols(batch.column("sig_a")) != _symbols(batch.column("sig_b"))
            first, total = other[:, :INDEXED].sum(axis=1), other.sum(axis=1)
            keep = pa.array((first <= near) & (total <= far))
            columns = [batch.column("a"), batch.column("b"), batch.column("weight"), pa.array(total.astype(np.int32))]
            out = pa.RecordBatch.from_arrays(columns, ["a", "b", "weight", "apart"])
            yield out.filter(keep)

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(fits).select("a", "b", "weight", "sig_a", "sig_b").mapInArrow(tx.tidied(run), "a long, b long, weight long, apart int")


def _texts(used: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the nodes in ``used``."""
    used = small(stored(used, "used"))
    want = stored(nodes.join(used, "node", "left_semi").select("node", "doc_id", "th"), "wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    rows = rows.join(small(want), rows.doc_id.eqNullSafe(want.doc_id) & (rows.th == want.th)).select("node", "text")
    return stored(rows.dropDuplicates(["node"]), "texts")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The stored pairs ``a, b`` whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.portions(batches, lambda b: b.column("text_b"), limit=tx.SHORT):
            left, right = (_sets(*tx.texts(batch.column(c)), size) for c in ("text_a", "text_b"))
            keep = []
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    text = _texts(used, nodes, docs)
    hubs = small(stored(pairs.groupBy("a").agg(F.count("*").alias("n")), "hubs"))
    parts = F.ceil(F.col("n") / HUB_ROWS).cast("long")
    hub_text = (
        hubs.join(text.withColumnRenamed("node", "a"), "a")
        .select("a", F.col("text").alias("text_a"), parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        .drop("parts")
    )
    spread = pairs.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    joined = spread.join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(hub_text, ["a", "part"])
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(tx.tidied(run), "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, for batches that are sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        value = table.column(key).to_numpy()
        if held and held[0].column(key)[0].as_py() != value[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        cuts = [0, *(np.flatnonzero(np.diff(value)) + 1), len(value)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            held.append(table.slice(i, j - i))
            if k < len(cuts) - 2:
                yield pa.concat_tables(held).combine_chunks()
                held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


class _Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _close(rows: DataFrame, percent: int) -> DataFrame:
    """Members of a key that lie in different groups and within the distance, as edges ``a, b`` that span them: at most one
    per member, not all pairs.

    ``rows`` has ``block, side, node, root, n_shingles, sig``, sorted by block within each partition. A block holds one
    slice of a key's members (side 0), or two slices (1 and 2) to be compared with each other.
    """
    near, far = allowed(INDEXED, percent), allowed(SYMBOLS, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "block"):
            node, root, size = (part.column(c).to_numpy() for c in ("node", "root", "n_shingles"))
            sig, side = _symbols(part.column("sig")), part.column("side").to_numpy()
            groups, found = _Groups(len(node)), []
            for i in range(len(node)):
                if side[i] == 2:
                    continue
                other = np.flatnonzero((root != root[i]) & (side == 2 if side[i] else np.arange(len(node)) > i))
                other = other[100 * np.minimum(size[i], size[other]) >= percent * np.maximum(size[i], size[other])]
                if len(other):
                    differ = sig[other] != sig[i]
                    other = other[(differ[:, :INDEXED].sum(axis=1) <= near) & (differ.sum(axis=1) <= far)]
                    found += [(int(node[i]), int(node[j])) for j in other.tolist() if groups.join(i, j)]
            yield _edges(found)

    return rows.mapInArrow(tx.tidied(run), "a long, b long")


def _exact(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between different groups, by the full shingle sets, as edges that span what is linked.

    ``rows`` has ``block, side, node, root, text``, sorted by block: two slices of a cluster, or one slice (side 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "block"):
            node, root, side = (part.column(c).to_numpy() for c in ("node", "root", "side"))
            sets = list(_sets(*tx.texts(part.column("text")), size))
            count = np.array([len(x) for x in sets])
            right = np.flatnonzero(side == 2) if side.any() else np.arange(len(node))
            every = np.concatenate([sets[j] for j in right])
            owner = np.repeat(np.arange(len(right)), count[right])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            groups, found = _Groups(len(node)), []
            for i in range(len(node)):
                if side[i] == 2:
                    continue
                first, last = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
                length = last - first
                at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
                both = np.bincount(owner[at], minlength=len(right))
                good = (100 * both >= percent * (count[i] + count[right] - both)) & (root[right] != root[i])
                found += [(int(node[i]), int(node[j])) for j in right[good].tolist() if groups.join(i, j)]
            yield _edges(found)

    return rows.mapInArrow(tx.tidied(run), "a long, b long")


def _clusters(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Slices of each cluster of close nodes, and the pairs of slices to compare: ``block, side, node, root``.

    A large group's members have slices of their own, which need not be compared with each other; members of small groups
    share slices.
    """
    clusters = components(edges).select("node", F.col("root").alias("cluster"))
    rows = stored(clusters.join(small(roots), "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root")), "clusters")
    large = stored(rows.groupBy("cluster", "root").agg(F.count("*").alias("n")), "cluster-groups")
    rows = rows.join(small(large), ["cluster", "root"]).withColumn("own", F.when(F.col("n") > SLICE_ROWS, F.col("root")))
    total = rows.groupBy("cluster", "own").agg(F.count("*").alias("m")).withColumn("slices", F.ceil(F.col("m") / SLICE_ROWS))
    total = stored(total.select(F.col("cluster"), "own", F.col("slices").cast("int").alias("slices")), "slices")
    same = rows.cluster.eqNullSafe(total.cluster) & rows.own.eqNullSafe(total.own)
    placed = rows.join(small(total), same).select(
        rows.cluster, rows.own, "node", "root", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice")
    )
    every = total.select(F.col("cluster"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other_slice"))
    both = placed.join(every, "cluster")
    mine, theirs = (F.struct(F.coalesce(o, F.lit(0)).alias("o"), s.alias("s"), o.isNull().alias("mixed")) for o, s in ((F.col("own"), F.col("slice")), (F.col("other"), F.col("other_slice"))))
    both = both.where(F.col("own").isNull() | F.col("other").isNull() | (F.col("own") != F.col("other")))
    side = F.when(mine == theirs, 0).when(mine < theirs, 1).otherwise(2)
    block = F.xxhash64("cluster", F.least(mine, theirs), F.greatest(mine, theirs))
    return both.select(block.alias("block"), side.alias("side"), "node", "root")


def _blocks(shared: DataFrame) -> DataFrame:
    """Cut each key's rows (``members`` of them) into slices by hash and pair the slices of large keys with each other."""
    slices = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    rows = shared.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    inside = rows.withColumn("x", F.col("own")).withColumn("y", F.col("own")).withColumn("side", F.lit(0))
    others = (
        rows.where("slices > 1")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .where("other <> own")
        .withColumn("x", F.least("own", "other"))
        .withColumn("y", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") < F.col("other"), 1).otherwise(2))
        .drop("other")
    )
    return inside.unionByName(others).withColumn("block", F.xxhash64("key", "x", "y")).select("block", "side", "node", "root", "n_shingles", "sig")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, th, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id``, ``text``; more columns are ignored).

    Words are compared with A-Z lower-cased. Two documents are linked when 100 x common >= percent x union of their distinct
    ``size``-word shingles; fewer words make one shingle of the whole sequence. ``component_id`` is the smallest id
    reachable over links, ``kept`` is ``doc_id = component_id``; ``th`` is xxhash64 of the text. A null, empty or
    wordless text has no shingles and no links, and is kept. Repeated rows each get a row. A null id never is a component's smallest if
    another id is in it. An empty table gives no rows.
    """
    signed = stored(signatures(docs, size), "signatures")
    nodes = stored(signed.where("node is not null").dropDuplicates(["node"]), "nodes")
    keyed = keys(nodes, percent)
    common = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    shared = stored(keyed.join(common, "key"), "members")
    central = stored(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    hubs = shared.join(small(central), "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    star = shared.join(hubs, "key").where("node <> hub.node").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), "hub.weight")
    star = _apart(star.groupBy("a", "b").agg(F.max("weight").alias("weight")), nodes, percent)
    star = stored(star, "hub-candidates")
    tried = roots = None
    while True:
        open_ = star if roots is None else _unlike(star, roots).join(tried, ["a", "b"], "left_anti")
        best = open_.groupBy("b").agg(F.max(F.struct("weight", -F.col("apart"), "a")).alias("best"))
        pairs = stored(best.select("best.a", "b"), "hub-pairs")
        links = stored(confirm(pairs, nodes, docs, size, percent), "hub-links")
        tried = pairs if tried is None else tried.union(pairs)
        roots = _joined(roots, links)
        if links.count() < GAIN * pairs.count() or not links.head(1):
            break
    placed = shared.join(small(roots), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("members")).where("p <> q")
    mixed = small(stored(mixed.select("key", "members"), "mixed-keys"))
    members = placed.join(mixed, "key").join(nodes.select("node", "n_shingles", "sig"), "node")
    blocks = _blocks(members).repartition("block").sortWithinPartitions("block")
    edges = stored(_close(blocks, percent).distinct(), "close")
    compared = stored(_clusters(edges, roots), "compared")
    text = _texts(compared.select("node").distinct(), nodes, docs)
    compared = compared.join(text, "node").repartition("block").sortWithinPartitions("block")
    roots = _joined(roots, stored(_exact(compared, size, percent), "cross-links"))
    full = signed.where("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("sig")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = full.join(least, "root").select("doc_id", "th", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    lone = signed.where("node is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(lone)
