import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareloom.llm import quality_classifier as qc
from wareloom.llm.tables import table

FOLDER = "/root/testdata/sf0.01"


def made(rng, good):
    words = [rng.choice("river stone light carries slowly under north letter".split()) for _ in range(rng.randint(30, 200))]
    return " ".join(words) if good else " ".join(w + "###" for w in words)


def test_chunks_cover_the_document_and_pooling_equals_a_plain_loop():
    net = qc.ByteConvNet.initial(3)
    rng = random.Random(1)
    texts = ["", "x", "a" * qc.CELL, "b" * (qc.CELL + 1), "".join(rng.choice("abc é") for _ in range(1000))]
    want = []
    for text in texts:
        raw = text.encode()
        cells = max(1, -(-len(raw) // qc.CELL))
        codes = qc.padded(raw, cells)
        response = np.array([sum(net.table[w][codes[p + w]] for w in range(qc.WIDTH)) for p in range(cells * qc.CELL)])
        chunks = [response[s * qc.CELL : (s + 2) * qc.CELL].max(axis=0) for s in range(max(1, cells - 1))]
        want.append(1 / (1 + np.exp(-np.mean(net.chunk_logits(np.array(chunks))))))
    assert np.allclose(net.scores(texts), want, atol=1e-5)
    assert np.allclose(net.scores(texts * 7), want * 7, atol=1e-5)


def test_gradients_equal_differences():
    net = qc.ByteConvNet.initial(2)
    for name in ("table", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(1)
    docs = [qc.Lesson(bytes(rng.integers(97, 110, n, dtype=np.uint8)), rng).chunks(0) for n in (300, 20, 900)]
    truth = np.array([1, 0, 1.0])

    def loss():
        total = 0
        for d, y in zip(docs, truth):
            span = d.shape[1] - qc.WIDTH + 1
            pooled = sum(net.table[w][d[:, w : w + span]] for w in range(qc.WIDTH)).max(axis=1)
            p = 1 / (1 + np.exp(-net.chunk_logits(pooled).mean()))
            total -= (y * np.log(p) + (1 - y) * np.log(1 - p)) / len(docs)
        return total + 0.5e-4 * sum((getattr(net, n) ** 2).sum() for n in ("table", "hidden", "out"))

    for name, gradient in qc.gradients(net, docs, truth).items():
        values = getattr(net, name)
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        before = values[at]
        values[at] = before + 1e-5
        high = loss()
        values[at] = before - 1e-5
        low = loss()
        values[at] = before
        assert np.isclose(gradient[at], (high - low) / 2e-5, rtol=1e-2, atol=1e-7), name


def test_fit_uses_no_held_out_row_and_learns(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, made(rng, i % 2 == 1)) for i in range(300)]
    seen = []
    original = qc.train
    monkeypatch.setattr(qc, "train", lambda texts, labels: seen.extend(texts) or original(texts, labels))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    net = qc.fit(docs, labels, sample=80)
    held = {t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert seen and not held & set(seen) and len(seen) <= 160
    scores = {r.doc_id: r.score for r in qc.score(docs, net).collect()}
    assert all((scores[i] >= qc.THRESHOLD) == (i % 2 == 1) for i, _ in rows)


def test_one_score_per_row(spark, odd_docs, odd_rows, no_docs):
    net = qc.ByteConvNet.initial()
    rows = qc.score(odd_docs, net).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert qc.score(no_docs, net).collect() == []
    assert Counter(tuple(r.doc) for r in qc.scored(odd_docs, net).collect()) == Counter(odd_rows)


def test_all_chunks_are_dealt_out_over_the_epochs():
    text = bytes(range(256)) * 500
    lesson = qc.Lesson(text, np.random.default_rng(1))
    seen = {bytes(row.astype(np.uint16)) for e in range(qc.EPOCHS) for row in lesson.chunks(e)}
    cells = -(-len(text) // qc.CELL)
    every = np.concatenate([qc.padded(text, cells), np.full(qc.CELL, 256, np.int16)])
    assert seen == {bytes(every[c * qc.CELL : c * qc.CELL + 2 * qc.CELL + qc.WIDTH - 1].astype(np.uint16)) for c in range(cells - 1)}
    assert len(qc.Lesson(b"", np.random.default_rng(1)).chunks(3)) == 1


def test_without_both_classes_every_text_is_even(spark, no_docs, odd_docs):
    assert set(qc.train([b"a", b"b"], [1, 1]).scores(["x", "", "y" * 999])) == {0.5}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.score(odd_docs, qc.fit(no_docs, labels)).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    rows = qc.score(docs, qc.fit(docs, labels)).join(labels, "doc_id").filter(qc.is_held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= qc.THRESHOLD) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) >= 0.95
