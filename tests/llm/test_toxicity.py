import random

import numpy as np
import pyarrow as pa
from helpers import docs_of, prose, words
from pyspark.sql import functions as F

from tallyforge.llm import toxicity
from tallyforge.llm.toxicity import SPAN, STEP, Network, Texts, score
from tallyforge.llm.words import _B, _C, _TABLE


def test_gradient_is_the_slope():
    g = np.random.default_rng(1)
    net = Network(2)
    net.p = {n: (v * 3).astype(np.float64) for n, v in net.p.items()}
    toxicity.F32 = np.float64
    try:
        t = Texts(pa.array(["Some words here, some more words", "and others", "", "here and there " * 30]))
        w, y = np.arange(len(t.doc)), g.integers(0, 2, len(t.doc)).astype(float)

        def loss():
            z = net.logits(net.gates(net.inputs(t)), *t.rows(w))
            return float(np.mean(np.log1p(np.exp(z)) - y * z))

        grad = net.gradient(t, w, y)
        for n, v in net.p.items():
            for i in [int(k) for k in np.argsort(-np.abs(grad[n]).ravel())[:3]]:
                old = v.ravel()[i]
                v.ravel()[i] = old + 1e-5
                up = loss()
                v.ravel()[i] = old - 1e-5
                down = loss()
                v.ravel()[i] = old
                assert abs((up - down) / 2e-5 - grad[n].ravel()[i]) < 1e-6, n
    finally:
        toxicity.F32 = np.float32


def test_windows_cover_every_word():
    for n in (0, 1, SPAN, SPAN + 1, SPAN + STEP, 500):
        t = Texts(pa.array(["a " * 7, "w " * n, None or ""]))
        got = {int(s) - 7 + j for s, k, d in zip(t.start, t.size, t.doc, strict=True) if d == 1 for j in range(k)}
        assert got == set(range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    texts, toxic = [], []
    for i in range(1200):
        w = prose(rng, rng.randrange(5, 400), 3000).split(" ")
        y = i % 4 == 0
        if y:
            for _ in range(1 + len(w) // 100):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["scumbag", "scumlike,", "idiot", "Idiot."]))
        texts.append(" ".join(w))
        toxic.append(int(y))
    texts += [None, "", " "]
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(5, None), (99999, 1)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    df = docs_of(spark, texts)
    rows = score(df, labels, ~held, labelled=400).withColumn("held", held).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held and r.doc_id < 1200]
    assert np.mean([(r.score >= 0.3) == bool(toxic[r.doc_id]) for r in test]) > 0.95
    assert all(r.score < 0.3 for r in rows if r.doc_id >= 1200)


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score(docs_of(spark, ["a", None]), none, F.lit(True)).collect()} == {0.0}
    one = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert {r.score for r in score(docs_of(spark, ["a", "b"]), one, F.lit(True)).collect()} == {1.0}
    assert score(docs_of(spark, ["a"]).limit(0), one, F.lit(True)).collect() == []


MASK = 2**64 - 1


def mixed(h):
    """The spreading of bits, on whole numbers."""
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & MASK
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & MASK
    return h ^ (h >> 33)


def plain_score(net, text, slope, shift):
    """One text, word by word and number by number."""
    p = {n: v.astype(np.float64) for n, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    inputs = []
    for w in words(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode())
        h = mixed(sum(int(_TABLE[c]) * pow(int(_B), i, 2**64) for i, c in enumerate(raw)) + len(raw) * int(_C) & MASK)
        marked, grams = [1, *raw, 1], []
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                g = n
                for c in marked[i : i + n]:
                    g = (g * 0x100000001B3 + c) & MASK
                grams.append(p["char"][mixed(g) % toxicity.BUCKETS])
        inputs.append(np.concatenate([p["word"][h % toxicity.BUCKETS], np.mean(grams, 0) if grams else np.zeros(toxicity.DIM)]))
    k, best = toxicity.HIDDEN, -np.inf
    for at in range(0, max(1, len(inputs) - SPAN + STEP), STEP):
        window = inputs[at : at + SPAN]
        states = {}
        for d, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            h = np.zeros(k)
            for i in order:
                a, b = window[i] @ p[f"in_{d}"] + p[f"bias_{d}"], h @ p[f"re_{d}"]
                z, r = sigmoid(a[:k] + b[:k]), sigmoid(a[k : 2 * k] + b[k : 2 * k])
                c = np.tanh(a[2 * k :] + r * b[2 * k :])
                h = z * h + (1 - z) * c
                states[d, i] = h
        both = [np.concatenate([states["f", i], states["b", i]]) for i in range(len(window))]
        e = np.exp([x @ p["look"] for x in both])
        pool = sum(w * x for w, x in zip(e / e.sum(), both)) if both else np.zeros(2 * k)
        best = max(best, float(pool @ p["out"] + p["prior"][0]))
    return sigmoid(slope * best + shift)


def test_scores_equal_a_plain_forward_pass(spark, monkeypatch):
    net = Network(5)
    net.p = {n: v * 3 for n, v in net.p.items()}
    net.p["prior"] += np.float32(0.3)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, **k: (net, 1.5, -0.25))
    rng = random.Random(9)
    texts = [None, "", " ", "a", "A", "ab Ünï x1", "one two three", "x" * 3000, prose(rng, SPAN), prose(rng, SPAN + 1), prose(rng, SPAN + STEP), prose(rng, SPAN + STEP + 1), prose(rng, 400), "Idiot! " * 90, "é " * 300]
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score(docs_of(spark, texts), labels, F.lit(True)).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(net, t or "", 1.5, -0.25)) < 2e-5, i
