"""Pooled language probabilities and quality training against plain loops; what the pipeline's stages do with copies and odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import language, near_dedup, quality, text
from assayer.llm.queries import table

FOLDER = "/root/testdata/sf0.001"


def plain_squash(x):
    x = min(3.0, max(-3.0, x))
    return x * (27 + x * x) / (27 + 9 * x * x)


def plain_states(net, raw, direction):
    """States after every byte of one direction, number by number."""
    size = net.inner.shape[-1]
    h, out = [0.0] * size, []
    for b in raw if direction == 0 else raw[::-1]:
        inner = [[sum(h[i] * net.inner[g, direction, i, j] for i in range(size)) for j in range(size)] for g in range(3)]
        gate = [[net.table[g, direction, b, j] for j in range(size)] for g in range(3)]
        reset, update = ([(1 + plain_squash(gate[g][j] + inner[g][j])) / 2 for j in range(size)] for g in (0, 1))
        candidate = [plain_squash(gate[2][j] + reset[j] * inner[2][j]) for j in range(size)]
        h = [update[j] * h[j] + (1 - update[j]) * candidate[j] for j in range(size)]
        out.append(h)
    return out if direction == 0 else out[::-1]


@pytest.mark.parametrize("window", [5, 128])
def test_pooling(window, monkeypatch):
    """Every byte is labelled from both directions inside its window; a text has the mean of its bytes."""
    monkeypatch.setattr(language, "WINDOW", window)
    rng = np.random.default_rng(3)
    net = language.Network(["a", "b", "c"], rng.normal(size=(3, 2, 256, 4)), 0.5 * rng.normal(size=(3, 2, 4, 4)), rng.normal(size=(8, 3)), rng.normal(size=3))
    texts = ["", "x", "héllo", "abcdefghijklm", "zz top", None, "q" * 11]
    got = language.pooled(net, *text.texts(pa.array(texts)))
    for value, found in zip(texts, got):
        raw = (value or "").encode()
        sums = np.zeros(3)
        for at in range(0, len(raw), window):
            part = raw[at : at + window]
            for f, b in zip(plain_states(net, part, 0), plain_states(net, part, 1)):
                e = np.exp(np.array([*f, *b]) @ net.head + net.bias)
                sums += e / e.sum()
        assert np.allclose(found, sums / max(1, len(raw)), atol=1e-9)


def test_training_of_quality():
    """FTRL-Proximal, coordinate by coordinate."""
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        number = sorted(rng.sample(range(12), rng.randint(1, 6)))
        rows.append((np.array(number), np.array([rng.random() for _ in number]), rng.randint(0, 1)))
    z, n = [0.0] * 13, [0.0] * 13  # the last one is the bias, without L1

    def weight(i):
        l1 = quality.L1 if i < 12 else 0.0
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for number, value, label in rows:
            x = {**dict(zip(number.tolist(), value.tolist())), 12: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    model = quality.train(rows, epochs=3)
    assert np.allclose(model.weights[:12], [weight(i) for i in range(12)], atol=1e-6) and not model.weights[12:].any()
    assert abs(model.bias - weight(12)) < 1e-9


def test_pipeline_leaves_copies_to_near_dedup(spark):
    """No document is emptied or cut to a stub by line removal, and nearly all copies found on whole texts still go."""
    docs = table(spark, FOLDER, "documents")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    lines = corpus_pipeline.dedup_lines(spark, docs, FOLDER)
    after = {r.doc_id: r.text or "" for r in lines.collect()}
    assert all(any(c.isalpha() for c in t) for i, t in after.items() if any(c.isalpha() for c in before[i]))
    assert all(len(t) >= (1 - corpus_pipeline.SPARE) * len(before[i]) for i, t in after.items())
    assert any(after[i] != t for i, t in before.items() if i in after)
    gone = {r.doc_id for r in near_dedup.near_duplicates(docs).where("not kept").collect()}
    kept = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, lines, FOLDER).collect()}
    assert len(gone) > 5 and len(gone & kept) <= 0.1 * len(gone)
    assert kept >= {i for i in after if i not in gone}


@pytest.mark.parametrize("stage", [s for n, s in corpus_pipeline.STAGES if n in ("line_dedup", "near_dedup", "decontamination")])
def test_stages_keep_odd_rows(spark, stage):
    """Null ids, null and empty texts, repeated rows and other columns' names do not break a stage; an empty table stays empty."""
    columns = list(corpus_pipeline.COLUMNS)
    docs = documents(spark, 200).select(*columns)
    got = stage(spark, docs, FOLDER)
    assert got.columns == columns
    clean = "Completely different words are written in this line of text about nothing at all"
    assert got.where(F.col("text") == clean).count() == 1
    assert stage(spark, empty(spark).select(*columns), FOLDER).count() == 0


def test_letterless_rests_go(spark):
    shared = "\n".join(f"words of line {i}" for i in range(3))
    rows = [(1, shared), (2, "\n".join([shared, *["-" * 60] * 5])), (3, None), (4, "---")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, FOLDER).collect()}
    assert got[1] == (shared, 1) and got[3] == (None, 1) and got[4] == ("---", 1)
    assert 2 not in got or got[2][0] == rows[1][1] or any(c.isalpha() for c in got[2][0])
