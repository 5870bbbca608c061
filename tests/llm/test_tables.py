"""Operators on urls, conversations and vectors, the registered queries and the pipeline."""

import functools
import re
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents
from harness import difference, duck, duck_rows, spark_rows

import corpus_pipeline
from assayer.llm import chat, decontaminate, neighbours, queries, url_filter

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    assert difference(spark_rows(queries.QUERIES[name](spark, FOLDER)), duck_rows(duck(FOLDER), queries.ORACLE[name])) is None


# ---- urls

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/en/1?x#y", "http://a.example.org/en/12", "http://example.org/es/", "http://example.org/es",
    "http://badexample.org/es/x", "http://x.y.com/fr/", "http://com/fr/a#b", "http://.com/de/", "http://a..org/", "http://org", "http://org?x=/", "http://org/#/",
    "ftp://user@a.org:80/", "x://a.org/://b.com/de/", "http://A.EXAMPLE.ORG/EN/1", "http://é.org/", "http://a.net/" + "x/" * 5000, "http://example.org/es/", "http://example.org/es/",
]


def plain_verdict(url, rules):
    """Host, path, rule and verdict by comparing with every rule."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x", "y", True) for i, u in enumerate(URLS)], "page_id long, url string, host string, key string, row boolean")
    rules = url_filter.rules_of(spark, queries.ALLOWED, queries.BLOCKED)
    listed = [(r.host, r.path, r.verdict) for r in rules.collect()]
    got = url_filter.judge(pages, rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_verdict(u, listed) for i, u in enumerate(URLS)}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    none = url_filter.judge(pages, rules.limit(0)).collect()
    assert len(none) == len(URLS) and {(r.rule, r.verdict) for r in none} == {(None, "allow")}


def test_many_rules(spark):
    """Hundreds of rules need several levels, and stay exact."""
    rng = random.Random(1)
    hosts = [f"{rng.choice('abc')}.h{rng.randrange(300)}.org" for _ in range(400)]
    rules = sorted({(h[rng.choice([0, 2]) :], rng.choice(["/", "/a", "/b/"]), rng.choice(["allow", "block"])) for h in hosts[:200]})
    rules = [r for r in rules if sum(x[:2] == r[:2] for x in rules) == 1]
    urls = [(i, f"http://{rng.choice(hosts)}/{rng.choice('abc')}/{rng.randrange(50)}") for i in range(3000)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), table).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_verdict(u, rules) for i, u in urls}


def test_cascade_is_exact():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 20000).astype(np.uint64) for _ in range(2))
    listed = np.arange(20000) < 3000
    out = url_filter.Cascade()
    here, there = (a[listed], b[listed]), (a[~listed], b[~listed])
    while len(here[0]):
        out.add(*here)
        inside = out.holds(len(out.levels) - 1, *there)
        here, there = (there[0][inside], there[1][inside]), here
    assert len(out.levels) > 2 and (out.listed(a, b) == listed).all()


# ---- chat


def least_price(roles):
    @functools.cache
    def go(i, state):
        if i == len(roles):
            return chat.ENDINGS[state][0]
        best = 10**9
        for after in (1, 2, 3):
            label = 0 if chat.ROLES[after] == roles[i] else chat.RELABEL
            if after in chat.FOLLOWS[state]:
                best = min(best, label + go(i + 1, after))
            if any(after in chat.FOLLOWS[m] for m in chat.FOLLOWS[state]):
                best = min(best, chat.INSERT + label + go(i + 1, after))
            if after == state:
                best = min(best, chat.MERGE + label + go(i + 1, after))
        return best

    return go(0, chat.START)


@pytest.mark.parametrize("block", [3, 4096])
def test_chat(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rng = random.Random(3)
    rows = [
        (i or None, t if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice([None, "", "hi", "x" * 50]), 1, "z")
        for i in range(30) for t in range(rng.randint(1, 25))
    ]
    rows += [(500, 0, "user", "y" * 1_000_000, 1, "z")] + [(501, 0, "user", "same", 1, "z")] * 4
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int, place string")
    pieces = defaultdict(list)
    for r in chat.repair(table).collect():
        pieces[r.conv_id].append(r)
    turns = defaultdict(list)
    for r in rows:
        turns[r[0]].append(r)
    price = {"keep": 0, "relabel": chat.RELABEL, "merge": chat.MERGE, "merge relabel": chat.MERGE + chat.RELABEL, "insert": chat.INSERT}
    order = lambda x: tuple((v is not None, v if v is not None else 0) for v in (x[1], x[2])) + (x[3] or "",)
    assert set(pieces) == set(turns)
    for conv, own in pieces.items():
        own.sort(key=lambda r: r.place)
        source = sorted(turns[conv], key=order)
        roles = tuple(r[2] if r[2] in chat.ROLES[1:] else None for r in source)
        assert sum(price[r.action] for r in own) == least_price(roles)
        assert [r.turn for r in own if r.action != "insert"] == [r[1] for r in source]
        whole = "".join(r.piece for r in own)
        seen = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
        assert whole.endswith(chat.CLOSE) and whole.count("<|end|>") == len(seen)
        seen = seen[1:] if seen[0] == "system" else seen
        assert seen and seen == ["user", "assistant"] * (len(seen) // 2)
        assert sum(len(r[3] or "") for r in source) == len(re.sub(r"\n?<\|\w+\|>\n", "", whole)) - 2 * sum(r.action.startswith("merge") for r in own)
    assert chat.repair(table.limit(0)).count() == 0
    assert chat.conversations(chat.repair(table)).count() == len(turns)


# ---- vectors


def exact(rows, queries_, k):
    out = {}
    use = [(i, np.array(v, float)) for i, v in rows]
    for q, v in queries_:
        least = {}
        for i, x in use:
            if i != q:
                d = float(np.sqrt(((x - np.array(v, float)) ** 2).sum()))
                least[i] = min(d, least.get(i, d))
        out.setdefault(q, []).extend(sorted((d, i) for i, d in least.items())[:k])
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)]  # ties
    good = list(rows)
    odd = [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [float("inf")] + [1.0] * 15), (6004, [None] + [1.0] * 15), (6005, [1.0] * 3), (None, [1.0] * 16), (6006, [])]
    again = [rows[100], rows[100], rows[200]]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd + again], "vec_id long, embedding array<float>, part int, v int")
    asked = table.where("vec_id % 100 = 0")
    found = defaultdict(list)
    for r in neighbours.search(table, asked, parts=8).collect():
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    want = exact(good + again, [r for r in good if r[0] % 100 == 0], 10)
    assert set(found) == set(want)
    hits = 0
    by_id = dict(good)
    for q, got in found.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        assert len({i for _, _, i in got}) == 10 and q not in {i for _, _, i in got}
        for _, score, i in got:
            assert abs(score - np.linalg.norm(np.array(by_id[q], float) - np.array(by_id[i], float))) < 1e-12
        hits += len({i for _, _, i in got} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_few_neighbours(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], kind)
    got = neighbours.search(few, few.where("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert neighbours.search(few.limit(0), few.limit(0)).count() == 0
    assert neighbours.search(few, few.limit(0)).count() == 0


def test_graph_parts_are_balanced():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(800, 8))
    part = neighbours.cut(neighbours.graph(vectors), 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.sum() == 800 and sizes.max() <= 1.06 * 100 and sizes.min() >= 0.9 * 100


# ---- pipeline


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_neighbours_of_small_clusters(spark, seed):
    """Where the routed parts hold too few vectors the query goes on, so it has k rows whenever there are k candidates."""
    rng = np.random.default_rng(seed)
    sizes = [3, 4, 150, 6, 60, 5]
    rows = [(i, (30 * np.eye(8)[c] + rng.normal(0, 0.1, 8)).tolist()) for i, c in enumerate(np.repeat(np.arange(6), sizes))]
    rows += [(i, (rng.normal(0, 5, 8)).tolist()) for i in (0, 1, 2)]  # ids that lie in several parts
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in neighbours.search(table, table.where("vec_id % 4 = 0"), parts=8).collect())
    assert got == {i: 10 for i in range(sum(sizes)) if i % 4 == 0}


def test_pipeline(spark):
    columns = list(corpus_pipeline.COLUMNS)
    docs = queries.table(spark, FOLDER, "documents")
    plain = docs.toPandas()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert kept.columns == columns and kept.count() == len(plain)  # every document of this table is in one language
    lines = corpus_pipeline.dedup_lines(spark, docs, FOLDER).toPandas()
    assert list(lines.columns) == columns and (lines.n_chars == lines.text.str.len()).all() and len(lines) == len(plain)
    clean = {r.doc_id for r in corpus_pipeline.remove_leaks(spark, docs, FOLDER).collect()}
    items = queries.table(spark, FOLDER, "benchmark").toPandas().text
    leaking = {d for d, t in zip(plain.doc_id, plain.text) if any(i in t for i in items)}
    assert not clean & leaking and len(clean) >= len(plain) - len(leaking) - 2
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and whole.count() > 0


def test_pipeline_keeps_one_of_each_group(spark):
    docs = documents(spark, 200).select(*corpus_pipeline.COLUMNS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, docs, FOLDER).collect())
    assert max(got.values()) == 1
    assert sum(t is not None and t.lower().startswith("the quick") for _, t in got) == 1
    assert (100, docs.where("doc_id = 100").first().text) in got and not any(d == 101 for d, _ in got)
    assert sum(d in (8, 9, 10) for d, _ in got) == 3  # texts without words stay


def test_pipeline_removes_what_it_cannot_read(spark):
    docs = documents(spark, 200).select(*corpus_pipeline.COLUMNS)
    got = corpus_pipeline.identify_language(spark, docs, FOLDER).collect()
    assert all(any(c.isalpha() for c in r.text or "") and r.lang is not None for r in got)


def test_items_below_the_shortest_length():
    assert decontaminate.item_of(1, "too short") is None and decontaminate.item_of(1, "long enough now") is not None and decontaminate.item_of(1, None) is None
