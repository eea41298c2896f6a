"""Operator 11 against a plain version, with texts cut into small chunks too."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import corpus, docs_of

from tallyforge.llm.importance import BETWEEN, STEP, fed, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n=3):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(texts, target, percent=5, least=20, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = ([0] * buckets for _ in "st")
    for count, of in ((s, [x for _, x in texts]), (t, target)):
        for x in of:
            for f in runs(x)[1]:
                count[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in texts:
        w, f = runs(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


@pytest.mark.parametrize(("long", "words"), [(1 << 18, 1 << 15), (40, 7), (1, 1)])
def test_equals_a_plain_version(spark, long, words):
    texts = corpus(4)[:110] + ["Ünï-cödé, x9 " * 30, "x" * 500 + " " + "y" * 70 + " y", "...", "A b\nC", "ſtraße K İ"]
    target = [texts[20], "one two three", None, "", "w1 w2 w3"]
    want = plain(list(enumerate(texts)), target)
    got = rows(resample(docs_of(spark, texts), spark.createDataFrame([(t, 7) for t in target], "text string, doc_id int"), percent=20, long=long, words=words))
    want = plain(list(enumerate(texts)), target, percent=20)
    assert sorted(got) == sorted(want) and sum(r[4] is not None for r in got) > 5


def test_ties_and_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    texts = [(3, text), (3, text), (None, text), (None, "short"), (5, text), (5, "other " + text)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, weight string")
    key = lambda r: tuple((v is None, v) for v in r)
    # equal rows draw places in any order
    got = sorted(rows(resample(docs, docs.select("text").limit(2), percent=100)), key=key)
    assert got == sorted(plain(texts, [text, text], percent=100), key=key)


def test_empty_tables(spark):
    docs = docs_of(spark, ["a b c " * 10, None])
    none = docs.limit(0)
    assert rows(resample(none, none.select("text"))) == []
    assert rows(resample(none, docs.select("text"))) == []
    assert sorted(rows(resample(docs, none.select("text")))) == sorted(plain([(0, "a b c " * 10), (1, None)], []))


def test_registers_are_those_of_the_library():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice((1, 2, 5, 63, 64, 65, 300)))) for _ in range(200)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    before = np.array([rng.randrange(2**32) for _ in words], np.uint32)
    got = fed(before, raw, start, size)
    assert [int(x) for x in got] == [zlib.crc32(w, int(b) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for w, b in zip(words, before)]
    assert [i for i in range(256) if not BETWEEN[i]] == [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)] and STEP[1] == 0x77073096
