"""Operators on document texts against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import LOWER, SPACE, documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import context_tree, decontaminate, language, line_dedup, near_dedup, packing, quality, text, shared
from assayer.llm.queries import tokenizer


def words_of(value):
    return re.findall(SPACE, (value or "").translate(LOWER))


@pytest.mark.parametrize("limit", [7, 1 << 21])
def test_words(limit, monkeypatch):
    monkeypatch.setattr(text.blocks, "__defaults__", (limit,))
    rng = random.Random(1)
    docs = [None, "", "  ", "Ab ab\tAB\n cd", "x", "é ü z", "a" * 50] + ["".join(rng.choice("abC \n") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    hashes, rows, begin, end = text.words(*text.texts(pa.array(docs)), places=True)
    want = [(i, w) for i, t in enumerate(docs) for w in words_of(t)]
    names: dict = {}
    assert [r for r, _ in want] == rows.tolist()
    for (_, word), value in zip(want, hashes.tolist()):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_hash_index():
    keys = np.unique(text.mix(np.arange(5000, dtype=np.uint64)))
    found = text.HashIndex(keys[::2]).find(keys)
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all()


# ---- near-duplicates


def groups_of(rows, size, percent):
    """Row number -> (set size, smallest id reachable)."""
    sets = []
    for _, value in rows:
        w = words_of(value)
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return [(len(sets[i]), min(least[find(i)], default=None)) for i in range(len(rows))]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    docs = documents(spark)
    rng = random.Random(2)
    base = [f"t{i}" for i in range(60)]
    varied = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        varied.append((1000 + i, " ".join(copy)))
    more = spark.createDataFrame(varied, "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, n, c, d == c) for (d, _), (n, c) in zip(rows, groups_of(rows, size, percent)))
    got = near_dedup.near_duplicates(docs, size=size, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_near_duplicates_blocks(spark, monkeypatch):
    """Small blocks and slices give the same groups as brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dedup, "SLICE_ROWS", 4)
    rng = random.Random(3)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(80)]
        for i in range(40):
            copy = list(base)
            for _ in range(rng.randint(2, 9)):
                copy[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
            rows.append((g * 100 + i, " ".join(copy)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    want = {d: c for (d, _), (_, c) in zip(rows, groups_of(rows, 3, 85))}
    assert {r.doc_id: r.component_id for r in found} == want


@pytest.mark.parametrize("rows", [500_000, 0])
def test_star_steps_shuffle_little(spark, monkeypatch, rows):
    plans = {}

    def stored(df, name, made=None):
        out = keep(df, name, made)
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return out

    keep = shared.stored
    monkeypatch.setattr(shared, "stored", stored)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", rows)
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 3), (8, 9), (7, 7), (9, 8)], "a long, b long")
    found = {r.node: r.root for r in shared.components(links).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert plans["large-star"].count("Aggregate") == 1  # the minima only, no distinct
    assert ("broadcast" in plans["large-star"]) == ("broadcast" in plans["small-star"]) == (rows > 0)


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


# ---- lines


@pytest.mark.parametrize("texts", [False, True])
def test_line_dedup(spark, monkeypatch, texts):
    monkeypatch.setattr(line_dedup, "_collide", lambda rows: texts) if texts else None
    docs = documents(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "removed_lines"]
    rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.th, r.text) for r in docs.withColumn("th", F.xxhash64("text")).collect() if r.text is not None})
    first, kept = {}, {}
    for has, doc, _, value in rows:
        lines, gone = value.split("\n"), set()
        for i, j in line_dedup.chunks(lines, line_dedup.SEEDS):
            own, at = first.setdefault("\n".join(lines[i : j + 1]), ((has, doc, value), i))
            if own != (has, doc, value) or i - at > j - i:
                gone |= set(range(i, j + 1))
        kept[doc if has else None, value] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    want = Counter((r.doc_id, None if r.text is None else kept[r.doc_id, r.text]) for r in docs.collect())
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert any(a != b for (_, a), b in kept.items())  # the shared lines are gone somewhere
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_chunks():
    """Chunks depend on their own lines only: a passage keeps its chunks whatever stands around it, and most of its lines are in one."""
    rng = random.Random(10)
    inside = total = 0
    for n in (2, 3, 5, 9):
        for _ in range(100):
            passage = [f"line {rng.random()}" for _ in range(n)]
            found = []
            for _ in range(2):
                head = [f"other {rng.random()}" for _ in range(rng.randint(0, 4))]
                lines = [*head, *passage, f"other {rng.random()}"]
                found.append({(i - len(head), j - len(head)) for i, j in line_dedup.chunks(lines, line_dedup.SEEDS) if i >= len(head) and j < len(head) + n})
            assert found[0] == found[1]
            inside += len({k for i, j in found[0] for k in range(i, j + 1)})
            total += n
    assert inside > 0.95 * total
    assert line_dedup.chunks(["", "", "a", ""], 8) == [] and line_dedup.chunks(["a"], 8) == []


def test_spared_copies(spark):
    """A copy stays whole for near_dedup to decide; a text with one repeated passage loses it."""
    rng = random.Random(11)
    line = lambda: " ".join(f"v{rng.randrange(10**9)}" for _ in range(12))
    base, passage = [line() for _ in range(20)], [line() for _ in range(5)]
    texts = [base, base, [*base[:18], line(), line()], [line() for _ in range(10)] + passage, passage + [line() for _ in range(10)]]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (len(r.text.split("\n")), r.removed_lines) for r in line_dedup.dedup_passages(docs, spare=0.5).collect()}
    assert got == {0: (20, 0), 1: (20, 0), 2: (20, 0), 3: (15, 0), 4: (10, 5)}
    got = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs, spare=0.5).collect()}
    assert got[0] == got[1] == got[2] == got[3] == 0 and got[4] >= 4


def test_passages(spark):
    """Planted passages of over 50 words between unlike lines go wholly, the lines around them stay; so does the first occurrence of every line."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passages = [[fresh(52 // n + 1) for _ in range(n)] for n in (1, 2, 3, 4, 7) for _ in range(6)]
    rows, kept = [], {}
    for i in range(2 * len(passages)):
        head, tail = [fresh(9) for _ in range(rng.randint(1, 3))], [fresh(9) for _ in range(rng.randint(1, 3))]
        rows.append((i, "\n".join(head + passages[i % len(passages)] + tail)))
        kept[i] = rows[-1][1] if i < len(passages) else "\n".join(head + tail)
    rows += [(200, "z\nz\nz"), (201, "a\n\n\nb"), (202, "c\n\n\nd"), (203, "z\nz\nz\ny"), (204, None), (205, "short"), (206, "short")]
    kept |= {200: "z\nz\nz", 201: "a\n\n\nb", 202: "c\n\n\nd", 203: "y", 204: None, 205: "short", 206: "short"}
    docs = spark.createDataFrame(rows + rows[-8:], "doc_id long, text string")  # repeated rows keep the same lines
    got = line_dedup.dedup_passages(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, kept[i]) for i, _ in rows + rows[-8:])
    sizes = lambda t: len((t or "").split("\n"))
    assert all(r.removed_lines == sizes(dict(rows)[r.doc_id]) - sizes(r.text) for r in got if r.text)
    every = lambda texts: {line for t in texts for line in (t or "").split("\n")}
    many = documents(spark)
    left = line_dedup.dedup_passages(many)
    assert left.count() == many.count()
    assert every(r.text for r in left.collect()) >= every(r.text for r in many.collect()) - {""}
    assert line_dedup.dedup_passages(empty(spark)).count() == 0


# ---- benchmark


def test_wand_finds_all():
    rng = np.random.default_rng(1)
    for _ in range(30):
        rows = sorted((t, int(i), float(rng.exponential(0.25))) for t in range(10) for i in np.flatnonzero(rng.random(200) < rng.choice([0.02, 0.3, 0.8])))
        index = decontaminate.Index([], {}, 1, 1.0)
        term, index.item, index.weight = (np.array(x) for x in zip(*rows))
        index.terms, first = np.unique(term, return_index=True)
        index.first, index.most = np.append(first, len(rows)), np.maximum.reduceat(index.weight, first)
        query = sorted(rng.choice(len(index.terms), 5, replace=False).tolist())
        sums = np.zeros(200)
        for t in query:
            a, b = index.first[t], index.first[t + 1]
            sums[index.item[a:b]] += index.weight[a:b]
        found = dict(index.search(query))
        assert set(found) == set(np.flatnonzero(sums >= 1).tolist())
        assert all(abs(found[i] - sums[i]) < 1e-9 for i in found)


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randrange(60)}" for _ in range(rng.randint(10, 40)))) for i in range(20)] + [(90, "short one"), (91, None), (92, "s1 s2 s3"), (93, "s4 s5 s6 s7 s8 s9 s1 s2 s3"), (None, "a b c d e f g h i j k l"), (0, "x " * 30)]
    docs = []
    for i in range(60):
        words = [f"q{rng.randrange(60)}" for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = items[i % 20][1].upper().split()
        if i % 6 == 0 and words:
            words[rng.randrange(len(words))] = "edited"
        docs.append((i, " ".join(words) + "!!!"))
    docs += [(200, None), (201, ""), (202, "A, b c d e f g h i j; k l."), (202, "A, b c d e f g h i j; k l."), (None, "a b c d e f g h i j k l")]
    docs += [(300, "x s1 s2 s3 y"), (301, "s1 s2 x s3"), (302, "s4 s5 s6 s7 s8 s9 s1 s2 s3"), (303, "s4 s5 s6 s7 s8 s9 s1 s2"), (304, "short one")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = Counter((r.doc_id, r.item_id) for r in got.collect())
    parsed = [x for x in (decontaminate.item_of(i, t) for i, t in items) if x]
    want = Counter()
    for doc, value in docs:
        hashes = text.words(*text.texts(pa.array([value])), gaps=text.MARKS)[0]
        for x in parsed:
            shares = [decontaminate.verify(x, hashes[a : a + x.span]) for a in range(0, max(1, len(hashes)), x.span // 2)]
            if any(q >= decontaminate.SHARE and s >= decontaminate.SHARE for q, s in shares):
                want[doc, x.item_id] += 1
    assert found == want and found[202, None] == 2
    assert all((i, i % 20) in found for i in range(3, 60, 6))
    assert [found[300, 92], found[301, 92], found[302, 92], found[302, 93], found[303, 93], found[304, 90]] == [1, 0, 1, 1, 0, 0]
    # an unrelated long item changes nothing
    more = [*items, (500, " ".join(f"other{k}" for k in range(2000)))]
    again = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(more, "item_id long, text string"))
    assert Counter((r.doc_id, r.item_id) for r in again.collect()) == found


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert decontaminate.leaks(documents(spark), none).count() == 0
    assert decontaminate.leaks(empty(spark), some).count() == 0


# ---- language


def test_gradient():
    rng = np.random.default_rng(0)
    shapes = ((3, 2, 256, 2), (3, 2, 2, 2), (4, 3), (3,))
    net = language.Network(["a", "b", "c"], *(rng.normal(0, 0.5, s) for s in shapes))
    windows, labels = rng.integers(0, 5, (7, 9)).astype(np.uint8), rng.integers(0, 3, 7)

    def loss():
        return -np.log(net.probabilities(windows, np.full(7, 9))[labels, :, np.arange(7)]).mean()

    for grad, weight in zip(language.gradients(net, windows, labels), (net.table, net.inner, net.head, net.bias)):
        for _ in range(5):
            at = tuple(rng.integers(0, 5 if n == 256 else n) for n in weight.shape)
            weight[at] += 1e-4
            up = loss()
            weight[at] -= 2e-4
            down = loss()
            weight[at] += 1e-4
            assert abs((up - down) / 2e-4 - grad[at]) < 1e-5


def test_language(spark):
    rng = random.Random(5)
    stems = {"en": ["the", "ing", "with", "tion"], "de": ["ung", "schön", "über", "ich"]}
    rows = [(i, " ".join("".join(rng.choices(stems[g], k=2)) for _ in range(rng.randint(3, 300))), g) for i in range(120) for g in [rng.choice(["en", "de"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs, F.col("doc_id") % 3 != 1)
    found = {r.doc_id: r for r in language.identify(docs, net).collect()}
    assert all(found[i].lang_pred == g for i, _, g in rows)
    odd = language.identify(documents(spark, 300_000), net)
    assert odd.columns == [c for c in documents(spark).columns if c != "score"] + ["lang_pred", "score"]
    rows = odd.collect()
    assert len(rows) == documents(spark).count()
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1 and (letter or r.score == 0)
    # a text's result does not depend on what is read beside it
    one = language.pooled(net, *text.texts(pa.array([rows[0].text])))
    all_ = language.pooled(net, *text.texts(pa.array([r.text for r in rows])))
    assert np.abs(one[0] - all_[0]).max() < 1e-5
    assert language.fit(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(documents(spark), None).collect()} == {"und"}
    assert language.identify(empty(spark), net).count() == 0


# ---- quality


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" + ("###" if i % 3 == 0 else "") for _ in range(rng.randint(20, 200))), int(i % 3 != 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (10**6, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    found = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((found[i] >= 0.5) == bool(y) for i, y in held)
    again = quality.score(documents(spark, 300_000), model, ["doc_id", "th", "row", "key"]).collect()
    assert len(again) == documents(spark).count() and all(0 <= r.score <= 1 for r in again)
    blank = {r.score for r in again if r.doc_id in (8, 9, 10)}
    assert len(blank) == 1
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(empty(spark), model, ["doc_id"]).count() == 0


def test_sparse_score_is_a_dot_product():
    data = ["Abc*** abc*** 12 12", "", None, "x " * 50]
    rows = list(quality.features(pa.array(data)))
    assert len(rows[1][0]) == len(rows[2][0]) == 0
    assert all(abs((v * v).sum() - 1) < 1e-9 for _, v in (rows[0], rows[3]))
    weights = np.random.default_rng(0).normal(size=1 << quality.BITS)
    dense = np.zeros(1 << quality.BITS)
    dense[rows[0][0]] = rows[0][1]
    assert abs(quality.Model(weights, 0.3).score(*rows[0]) - 1 / (1 + math.exp(-(0.3 + dense @ weights)))) < 1e-9


# ---- packing


def plain_tokenizer():
    """The library's tokenizer as the file gives it."""
    encoder = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    encoder.no_truncation()
    encoder.no_padding()
    return encoder


@pytest.mark.parametrize("limit,cache", [(64, 1 << 30), (64, 2000), (1 << 21, 1 << 30)])
def test_segments(limit, cache, monkeypatch):
    monkeypatch.setattr(text, "BLOCK", limit)
    monkeypatch.setattr(packing, "CACHE_BYTES", cache)  # a small cache forgets and learns again
    text._powers.cache_clear()
    rng = random.Random(3)
    marks = ["a", "b", "The", "é", "ñ", " ", "  ", "\n", "\n\n", "\t", " ", " ", "　", " ", "'s", "'ll", "1", "22", "!", "...", "中", "\r\n", "<|endoftext|>", "\x1c", "\x85", "’"]
    docs = [None, "", " ", "\n", "a ", "a\n"] + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    encoder = packing.Segments(tokenizer("byte_bpe_50k.json"))
    flat, begin = encoder.encode(*text.texts(pa.array(docs)))
    want = plain_tokenizer().encode_batch([x or "" for x in docs], add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(begin, begin[1:])] == [w.ids for w in want]
    text._powers.cache_clear()


def test_words_are_learned_without_their_marks():
    words = ["house", "été", "über", "don't", "a×b"]
    docs = [" ".join(w + m for w in words for m in ("", ",", ".", "...", "?!", "|x|", "'s,")), "<|endoftext|>, a<|endoftext|>b.<|x|>", "ASCII,c'll.d x\n,y", "Ã, ©. \u0301a ª."]
    encoder = packing.Segments(tokenizer("byte_bpe_50k.json"))
    want = [w.ids for w in plain_tokenizer().encode_batch(docs, add_special_tokens=False)]
    for _ in range(2):
        flat, begin = encoder.encode(*text.texts(pa.array(docs)))
        assert [flat[a:b].tolist() for a, b in zip(begin, begin[1:])] == want
    encoder.clear()
    encoder.encode(*text.texts(pa.array(["a house. house, house! house"])))
    assert len(encoder.known) == 5  # "a", " house", ".", ",", "!"
    assert encoder._ids(["Ġhouse\nĠhouses"], bare=True)[0].tolist() == plain_tokenizer().encode(" house houses").ids


def best_of(sizes, capacity):
    """Fewest sequences, by search over all assignments."""
    sizes = sorted(sizes, reverse=True)

    def fits(bins):
        room = [capacity] * bins

        def place(i):
            if i == len(sizes):
                return True
            tried = set()
            for b in range(bins):
                if room[b] >= sizes[i] and room[b] not in tried:
                    tried.add(room[b])
                    room[b] -= sizes[i]
                    if place(i + 1):
                        return True
                    room[b] += sizes[i]
            return False

        return place(0)

    return next(n for n in range(len(sizes) + 1) if fits(n))


def test_reduction_keeps_the_optimum():
    rng = random.Random(7)
    for trial in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.reduce_exactly(counts)
        rest = [s for s, n in enumerate(counts) for _ in range(n)]
        assert all(sum(a * b for a, b in runs) <= capacity for _, runs in fixed)
        assert sum(m for m, _ in fixed) + best_of(rest, capacity) == best_of(sizes, capacity), sizes


def test_plan_holds_every_piece():
    rng = random.Random(8)
    for trial in range(60):
        capacity = rng.choice([10, 100, 1024])
        sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 300)))
        held = Counter()
        for copies, runs in packing.plan(dict(sizes), capacity):
            assert copies > 0 and sum(a * b for a, b in runs) <= capacity
            for length, many in runs:
                held[length] += copies * many
        assert held == sizes


def test_pack(spark):
    docs = documents(spark, 5000)
    path = tokenizer("byte_bpe_50k.json")
    docs = docs.unionByName(spark.createDataFrame([(500, "one<|endoftext|> two <|endoftext|>")], "doc_id long, text string"), allowMissingColumns=True)
    found = packing.pack(docs, path, capacity=64, ids=True).collect()
    encoder = plain_tokenizer()
    want = Counter()
    for r in docs.collect():
        ids = encoder.encode(r.text or "", add_special_tokens=False).ids + [2]
        a, b, k = 0, len(ids) % 64 or min(64, len(ids)), 0
        while a < len(ids):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
            a, b, k = b, b + 64, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found) == want
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty(spark), path).count() == 0


# ---- context trees


def context_tree_score(rows, train, depth):
    """Context-tree weighting by recursion over dictionaries."""
    lower = [(t or "").translate(LOWER).encode() for t in rows]
    counts, kids = {}, defaultdict(set)
    for raw, used in zip(lower, train):
        b = bytes(depth) + raw
        for p in range(depth, len(b)) if used else ():
            for k in range(8):
                j, bit = (1 << k) | (b[p] >> (8 - k)), (b[p] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts.setdefault((b[p - d : p], j), [0, 0])[bit] += 1
                    if d:
                        kids[b[p - d + 1 : p], j].add((b[p - d : p], j))
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        own = estimate(*counts[node])
        if len(node[0]) == depth:
            return own
        below = sum(weighted(k) for k in kids[node])
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def one(context, j):
        p = 0.5
        for d in range(depth, -1, -1):
            node = (context[depth - d :], j)
            a, b = counts.get(node, (0, 0))
            kt = (b + 0.5) / (a + b + 1)
            ratio = math.exp(min(700, estimate(a, b) - sum(weighted(k) for k in kids[node]))) if a + b else 1.0
            p = kt if d == depth else (ratio * kt + p) / (1 + ratio)
        return p

    out = []
    for raw in lower:
        b, total = bytes(depth) + raw, 0.0
        for p in range(depth, len(b)):
            for k in range(8):
                q = one(b[p - depth : p], (1 << k) | (b[p] >> (8 - k)))
                total += math.log10(q if (b[p] >> (7 - k)) & 1 else 1 - q)
        out.append(total)
    return out


@pytest.mark.parametrize("sent", [1 << 20, 20])
def test_context_tree(spark, monkeypatch, sent):
    """With few entries sent to the tasks, the joined rest gives the same scores."""
    monkeypatch.setattr(context_tree, "SENT", sent)
    docs = documents(spark, 10)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [i is None or i % 3 != 1 for i, _ in rows]
    found = context_tree.score(docs, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)), ["doc_id", "text", "row", "key"], depth=2).collect()
    tokens = [words_of(t) + [None] for _, t in rows]
    counts = Counter(w for x, used in zip(tokens, train) if used for w in x)
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for (i, t), x, s in zip(rows, tokens, context_tree_score([t for _, t in rows], train, 2)):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)
        want[i, t].append((len(x), sum(counts[w] > 0 for w in x), n, base, s))
    assert len(found) == len(rows)
    for r in found:
        w = want[r.doc_id, r.text].pop()
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert abs(r.base_score - w[3]) < 1e-8 and abs(r.score - w[4]) < 1e-8
        assert (r.bits_per_byte is None) == (not r.text)


@pytest.mark.parametrize("cut,group", [(0, 1 << 20), (1, 1 << 20), (3, 1 << 20), (1, 1)])
def test_context_tree_deep(spark, monkeypatch, cut, group):
    """However many levels are tables, the scores are those of the recursion."""
    monkeypatch.setattr(context_tree, "CUT", cut)
    monkeypatch.setattr(context_tree, "GROUP_GRAMS", group)
    monkeypatch.setattr(context_tree, "TASK_GRAMS", 100)
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abB \xe9") for _ in range(rng.randint(0, 40)))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (4, 7):
        found = {r.doc_id: r.score for r in context_tree.score(docs, F.col("doc_id") % 3 != 1, ["doc_id"], depth=depth).collect()}
        want = context_tree_score([t for _, t in rows], [i % 3 != 1 for i, _ in rows], depth)
        assert all(abs(found[i] - w) < 1e-8 for (i, _), w in zip(rows, want))


def test_context_tree_beats_words(spark):
    """The default depth reaches from the last letters of these words to the first ones, so held-out texts score above the word model."""
    rng = random.Random(12)
    names = [[f"{a}{b}mmm{a}{b}" for a in part for b in "ijklmnop"] for part in ("abcd", "efgh")]
    rows = [(i, " ".join(rng.choice(names[k % 2]) for k in range(200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 3 == 1
    found = [r for r in context_tree.score(docs.withColumn("held", held), ~held, ["doc_id", "held"]).collect() if r.held]
    assert len(found) == 20 and all(r.score > r.base_score for r in found)


def test_context_tree_empty(spark):
    assert context_tree.score(empty(spark), F.lit(True), ["doc_id"]).count() == 0
    none = context_tree.score(documents(spark, 10), F.lit(False), ["doc_id"]).collect()
    assert all(r.train_tokens == 0 and abs(r.base_score) < 1e-12 for r in none)
    assert all(abs(r.bits_per_byte - 8) < 1e-9 for r in none if r.n_bytes)


def test_context_tree_lists(monkeypatch):
    """What is left of a text goes in lists of bounded length, each distinct key once with its number."""
    monkeypatch.setattr(context_tree, "LISTED", 3)
    rows, keys = np.array([2, 0, 2, 2, 2, 2, 0]), np.array([9, 7, 8, 9, 5, 4, 7], dtype=np.uint64)
    [(row, kind, size, key, many)] = context_tree._lists([(rows, keys, 1), (rows[:0], keys[:0], 0)])
    assert row.tolist() == [0, 2, 2] and kind.tolist() == [1, 1, 1] and size.tolist() == [1, 3, 1]
    assert sorted(zip(np.repeat(row, size).tolist(), key.tolist(), many.tolist())) == [(0, 7, 2), (2, 4, 1), (2, 5, 1), (2, 8, 1), (2, 9, 2)]


def test_memory_is_given_back_after_the_last_work_arrays(monkeypatch):
    """The work arrays of a task's last batch are gone when the memory is given back."""
    class Arrays:
        def __del__(self):
            events.append("freed")

    events = []
    monkeypatch.setattr(text, "release", lambda: events.append("release"))

    def run(batches):
        for _ in batches:
            work = Arrays()  # noqa: F841
            yield 1

    assert sum(text.tidied(run)(iter([0]))) == 1 and events == ["freed", "release"]


def test_work_arrays_of_short_portions_are_small():
    """Fingerprints are the same in short portions, and their work arrays a fraction of those of a whole block."""
    import tracemalloc

    part = "Some words, and more of them. " * 4000
    whole = text.words(*text.texts(pa.array([part * 8])))[0]
    text._powers.cache_clear()
    tracemalloc.start()
    short = text.words(*text.texts(pa.array([part])))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (whole.reshape(8, -1) == short).all() and peak < 14 << 20  # 24 MB and more with the tables of a block


def test_no_rows_from_python_lists(spark, tmp_path):
    """Rows of a Python list start workers of another kind, which stay on every executor beside those of the operators."""
    for name, rows, kind in (("docs", [(1, "a b c"), (2, None)], "doc_id long, text string"), ("items", [(1, "a b c d e f g h i j k l")], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}")
    docs, items = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "items"))
    for found in (packing.pack(docs, tokenizer("byte_bpe_50k.json")), decontaminate.leaks(docs, items), decontaminate.leaks(docs, items.where("false"))):
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()
