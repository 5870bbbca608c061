"""Ranked search, BPE and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import LOWER, documents, empty
from tokenizers import Tokenizer

from assayer.llm import bpe, lexical, periodic, queries, text

PATH = queries.tokenizer("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- ranked search


def ranked(docs, items, top=20):
    """(item, rank, doc, score) by scoring every document."""
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    total = sum(1 for _, c in terms if c)
    length = sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, q in asked.items():
        scored = []
        for doc, c in terms:
            n, score = sum(c.values()), 0
            for w, often in q.items():
                if c[w]:
                    m = 100 - 25 + 25 * n * total // length
                    score += often * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m))
            if score:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def some_texts(rng, n, words=60):
    """Texts of a few frequent and many rare words, in three groups of like texts."""
    out = []
    for i in range(n):
        part = [f"g{i % 3}w{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randint(0, words))]
        out.append((i, " ".join(part + ["the"] * rng.randint(0, 5))))
    return out


@pytest.mark.parametrize("segment,block", [(2048, 64), (50, 4), (7, 1)])
def test_rank(spark, monkeypatch, segment, block):
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(1)
    docs = some_texts(rng, 400) + [(1000 + i, t) for i, t in some_texts(random.Random(1), 30)]
    items = [(i, t) for i, t in some_texts(rng, 25, 20)] + [(3, "the THE g1w1 Ünï-g2w7"), (None, "g0w3 the"), (90, None), (91, "nowhere found"), (92, "")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()) == ranked(docs, items)


def test_rank_skips():
    """Blocks are skipped once twenty good documents are known, and the result stays that of all documents."""
    rng = np.random.default_rng(1)
    size = rng.integers(1, 12, 600)
    terms = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in size])
    impact = rng.integers(1, 1000, len(terms)) ** 2
    segment = lexical.Segment(np.arange(600), size, terms, impact)
    weight = rng.integers(1, 3000, 6)
    asked = np.sort(rng.choice(40, 6, replace=False))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    scores, ids = segment.search(asked, weight, none, 20)
    value = np.zeros(40, np.int64)
    value[asked] = weight
    sums = np.bincount(np.repeat(np.arange(600), size), value[terms] * impact, 600).astype(np.int64)
    order = np.lexsort((np.arange(600), -sums))[:20]
    assert scores.tolist() == sums[order].tolist() and ids.tolist() == order.tolist()
    assert segment.skipped > 0


def test_rank_cases(spark, monkeypatch):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(1, "the quick brown fox"), (2, "one w49 w1"), (2, "one w49 w1"), (2, "two"), (3, "é ñ line shared")]
    table = spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id long, text string, score long, rank string")
    assert Counter(tuple(r) for r in lexical.rank(docs, table).select("item_id", "rank", "doc_id", "score").collect()) == ranked(rows, items)
    monkeypatch.setattr(lexical, "ITEMS", 1)  # several passes give the same
    assert Counter(tuple(r) for r in lexical.rank(docs, table).collect()) == ranked(rows, items)
    assert lexical.rank(empty(spark), table).count() == 0
    assert lexical.rank(docs, table.limit(0)).count() == 0


# ---- BPE

MARKS = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'re", "'LL", "'", "1", "23", "é", "中", "文", " ", "　", "\x00", "\x1c", "\x85", "!", "..", "😀", "Ⅷ", "́", "Ᲊ", "\U0001fbf0", "<|endoftext|>", "<|endof", "text|>", "\r\n"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("block,chunk", [(1 << 20, 4 << 20), (64, 300), (7, 20)])
def test_bpe(library, monkeypatch, block, chunk):
    monkeypatch.setattr(text, "BLOCK", block)
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    rng = random.Random(block)
    docs = [None, "", " ", "<|endoftext|>", "a" * 999, "ab" * 500, " " * 300 + "x", "the " * 300]
    docs += ["".join(rng.choice(MARKS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    words = bpe.vocabulary(PATH)
    ids, begin = words.encode(*text.texts(pa.array(docs, pa.string())))
    for i, want in enumerate(library.encode_batch([d or "" for d in docs], add_special_tokens=False)):
        own = ids[begin[i] : begin[i + 1]]
        assert own.tolist() == want.ids, docs[i]
        assert words.decode(own).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_equal_fingerprints(library, monkeypatch):
    """Pieces with equal fingerprints but other bytes are told apart."""
    monkeypatch.setattr(bpe, "_fingerprints", lambda part, b: (np.diff(np.append(b, len(part))) % 3).astype(np.uint64))
    docs = ["some words of a text, and others of it", "other words"]
    ids, begin = bpe.Vocabulary(PATH).encode(*text.texts(pa.array(docs)))
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [x.ids for x in library.encode_batch(docs, add_special_tokens=False)]


def test_bpe_tables(spark, library):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got.collect()) == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows)
    digests = Counter(tuple(r) for r in bpe.digest(got).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert digests == Counter(want)
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 50256, -1, 10**6, 0]), (4, [127])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: "", 2: "", 3: "<|endoftext|>!", 4: library.decode([127], skip_special_tokens=False)}


def test_bpe_bad_file(tmp_path):
    import json

    file = json.load(open(PATH))
    file["model"]["merges"] = [["Ġt", "he"], *file["model"]["merges"]]
    (tmp_path / "late.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "late.json"))
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "space.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "space.json"))


# ---- periodic runs


def plain_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("least,exponent", [(6, 4), (6, 2), (2, 2), (3, 3), (1, 5)])
def test_runs(least, exponent, monkeypatch):
    monkeypatch.setattr(periodic, "SPAN", 3)
    rng = random.Random(least * 10 + exponent)
    for _ in range(600):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            base = [rng.randrange(5) for _ in range(rng.randint(1, 7))]
            w = [9] * rng.randint(0, 2) + [base[i % len(base)] for i in range(rng.randint(0, 60))] + w
        assert periodic.runs_of(np.array(w, dtype=np.int64), least, exponent) == plain_runs(w, least, exponent)


def test_run_tables(spark):
    """Runs, collapsed texts and digests of the query, with its planted stretches."""
    docs = documents(spark, 3000)
    extra = [(200 + i, " ".join(["x"] * i + ["a b"] * (i % 5) + ["c"])) for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1] * math.prod(x[2] for x in runs) // r[2], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = periodic.digest(periodic.find_runs(queries.with_planted_runs(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert periodic.find_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, exponent=1)


def test_run_outputs(spark):
    docs = spark.createDataFrame([(1, "to be to be to be to be or not", 3), (2, None, 4), (2, "", 5)], "doc_id long, text string, runs long")
    got = {(r.doc_id, r.n_words): (r.runs, r.collapsed) for r in periodic.find_runs(docs).collect()}
    assert got == {(1, 10): ([(0, 8, 2)], "to be or not"), (2, 0): ([], "")}
