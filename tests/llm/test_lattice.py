import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from helpers import corpus, docs_of, lower, words
from pyspark.sql import functions as F

from tallyforge.llm.lattice import Lattice, score, vocabulary

PATH = P.path("piece_bpe_32k.model")


def all_ways(marked, p):
    """Probability of a marked word by adding up every segmentation."""
    if not marked:
        return 1.0
    return sum(p[marked[:i]] * all_ways(marked[i:], p) for i in range(1, len(marked) + 1) if marked[:i] in p)


def test_lattice_equals_all_segmentations():
    rng = random.Random(1)
    pieces = ["▁".encode(), *(bytes([b]) for b in range(256)), b"ab", b"abc", b"bc", "▁a".encode(), "▁ab".encode(), b"caa", "é".encode()]
    w = np.random.default_rng(1).random(len(pieces))
    model = Lattice(pieces, np.log(w / w.sum()))
    p = dict(zip(pieces, w / w.sum(), strict=True))
    some = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))).encode() for _ in range(120)]
    got = model.log_probs(some)
    assert np.allclose(got, [math.log(all_ways("▁".encode() + s, p)) for s in some])
    # expected counts: the derivative of the log probability by a piece's log weight
    n = model.expected(some, np.ones(len(some)))
    i = pieces.index(b"ab")
    model.logp[i] += 1e-6
    assert abs((model.log_probs(some).sum() - got.sum()) / 1e-6 - n[i]) < 1e-3
    assert np.isfinite(model.log_probs([b"x" * 20000])).all()


def test_counts_and_scores(spark):
    rng = random.Random(9)
    stems = ["the", "er", "on", "an", "re", "hel", "tion", "ing", "ou"]
    texts = corpus(4) + [" ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(60))) for _ in range(150)]
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    rows = {r.doc_id: r for r in score(docs_of(spark, texts), learn, PATH, frequent=40).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    each = {i: words(lower(t)) for i, t in enumerate(texts)}
    c = Counter(w for i in each if not held[i] for w in [*each[i], None])
    n, v = sum(c.values()), len(c)
    assert set(rows) == set(each)
    lp = {}
    for i, w in each.items():
        r = rows[i]
        assert r.learned != held[i] and r.train_tokens == n
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in [*w, None])
        assert abs(r.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])) < 1e-6 * (1 + len(w))
        if len(w) == 1:
            lp[w[0]] = r.score
    # a text's score is the sum over its words and the end: from one-word texts, by differences
    end = next(rows[i].score for i, w in each.items() if not w)
    assert end < 0
    for i, w in each.items():
        if w and all(x in lp for x in w):
            assert abs(rows[i].score - end - sum(lp[x] - end for x in w)) < 1e-6 * len(w)
    # the estimate makes the training texts likelier
    before = {r.doc_id: r.score for r in score(docs_of(spark, texts), learn, PATH, rounds=0).collect()}
    assert sum(rows[i].score - before[i] for i in each if not held[i]) > 0


def test_vocabulary_covers_all_bytes():
    pieces, logp = vocabulary(PATH)
    assert {bytes([b]) for b in range(256)} <= set(pieces) and len(pieces) > 30000
    assert abs(np.exp(logp).sum() - 1) < 1e-9


def test_empty_table(spark):
    assert score(docs_of(spark, ["a"]).limit(0), F.lit(True), PATH).collect() == []
    assert score(docs_of(spark, ["a b"]), F.lit(False), PATH).first().train_tokens == 0
