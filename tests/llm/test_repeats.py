import random
from collections import Counter

import numpy as np
from helpers import corpus, docs_of, prose, words

from tallyforge.llm.repeats import _slide, substring_dedup


def brute(texts, window):
    first = {}
    each = [words(t) for t in texts]
    for i, w in enumerate(each):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in enumerate(each):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    texts = corpus(2)
    passages = [prose(rng, rng.randrange(40, 90), 10**6) for _ in range(5)]
    for _ in range(40):  # passages at ends, next to one another, cut short by a few words
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages).split(" ")
            parts += p[rng.randrange(0, 6) : len(p) - rng.randrange(0, 6)]
            parts += prose(rng, rng.randrange(0, 20), 10**6).split(" ") if rng.random() < 0.7 else []
        texts.append(" ".join(parts))
    texts += ["x y " * 60, "x y " * 40 + "z", "éà " * 80]
    got = sorted(tuple(r) for r in substring_dedup(docs_of(spark, texts)).collect())
    assert got == brute(texts, 50)
    got = sorted(tuple(r) for r in substring_dedup(docs_of(spark, texts), window=8, k=3).collect())
    assert got == brute(texts, 8)


def test_no_window_at_all_and_empty_table(spark):
    assert [tuple(r) for r in substring_dedup(docs_of(spark, ["a b"])).collect()] == [(0, 2, 0, "a b")]
    assert substring_dedup(docs_of(spark, ["a"]).limit(0)).collect() == []


def test_slide():
    x = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    for size in (1, 5, 57):
        for f in (np.minimum, np.maximum):
            assert _slide(x, size, f).tolist() == [int(f.reduce(x[i : i + size])) for i in range(len(x) - size + 1)]


def test_matches_grow_through_other_documents(spark):
    """The earliest document of an anchor shares little; later ones share more with one another, on one side or on both."""
    rng = random.Random(9)
    core = prose(rng, 30, 10**6).split(" ")
    texts = []
    sides = [prose(rng, 40, 10**6).split(" ") for _ in range(4)]
    for i in range(40):
        a, b = rng.randrange(41), rng.randrange(41)
        left, right = rng.choice(sides), rng.choice(sides)
        texts.append(" ".join([*prose(rng, 5, 10**6).split(" "), *left[40 - a :], *core, *right[:b], *prose(rng, 5, 10**6).split(" ")]))
    docs = docs_of(spark, texts)
    for most in (20_000, 3):  # all rounds in tasks, and rounds that are joins
        got = sorted(tuple(r) for r in substring_dedup(docs, most=most).collect())
        assert got == brute(texts, 50) and sum(r[2] > 0 for r in got) > 10


def test_null_and_repeated_ids(spark):
    p = prose(random.Random(4), 60, 10**6)
    rows = [(7, p), (7, "x " + p), (None, p), (2, "a"), (None, None), (2, "a")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(got.values()) == 6 and got[(2, 1, 0)] == 2 and got[(None, 0, 0)] == 1 and got[(None, 60, 60)] == 1
    # of two rows with one id, one comes first
    assert (got[(7, 60, 0)], got[(7, 61, 60)]) in ((1, 1), (0, 0)) and (got[(7, 60, 60)], got[(7, 61, 0)]) in ((1, 1), (0, 0))
