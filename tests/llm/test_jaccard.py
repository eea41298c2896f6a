import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import corpus, docs_of, edited, lower, prose, words
from pyspark.sql import functions as F

from tallyforge.functions.shared import shared_folder
from tallyforge.llm import jaccard, scratch
from tallyforge.llm.jaccard import Often, jaccard_join


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and den * n >= num * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


def test_components_equal_brute_force(spark):
    texts = corpus()
    for k, num, den, block in ((4, 85, 100, 128), (5, 80, 100, 3), (2, 60, 100, 4)):
        got = {tuple(r) for r in jaccard_join(docs_of(spark, texts), k, num, den, block).collect()}
        assert got == brute(texts, k, num, den)


def test_empty_table(spark):
    assert jaccard_join(docs_of(spark, ["a"]).limit(0)).collect() == []


def test_a_shingle_in_every_document_and_distinct_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    rng = random.Random(11)
    common = prose(rng, 30, 10**6)  # in every document
    texts = []
    for _ in range(12):  # families: near copies, and members about the threshold from one another
        base = prose(rng, 120, 10**6)
        texts += [f"{common} {edited(rng, base, n)}" for n in (0, 1, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8)]
    texts += [f"{common} {prose(rng, rng.randrange(1, 12), 10**6)}" for _ in range(30)]  # hardly more than that
    texts += [f"{prose(rng, 40, 10**6)} {common}" for _ in range(60)]
    rng.shuffle(texts)
    for block in (128, 3):
        got = {tuple(r) for r in jaccard_join(docs_of(spark, texts), 4, 85, 100, block).collect()}
        assert got == brute(texts, 4, 85, 100)


def test_frequent_shingles_are_counted_over_the_whole_task():
    o = jaccard.Often(most=50, pending=4000)
    rng = np.random.default_rng(1)
    for i in range(40):
        h = rng.integers(0, 2**63, 500).astype(np.uint64)
        o.add(np.append(h, np.uint64(7)) if i % 2 else h)  # once in every second slice
    o.settle()
    assert 7 in o.keys.tolist() and len(o.keys) <= 50 and o.counts[o.keys == 7][0] >= 10


def test_null_and_repeated_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(5, a), (5, a), (None, a), (3, b), (9, b.upper()), (None, None), (3, "")]
    got = Counter(tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert got == Counter([(5, 3, 5), (5, 3, 5), (None, 3, 5), (3, 2, 3), (9, 2, 3), (None, 0, None), (3, 0, 3)])


def test_often_counts_as_a_plain_count():
    rng = np.random.default_rng(2)
    often, plain = Often(pending=10**9), Counter()
    for _ in range(2):
        h = rng.integers(0, 60, 90).astype(np.uint64)
        often.add(h)
        often.settle()
        for x, n in Counter(h.tolist()).items():
            if x in plain or n > 1:
                plain[x] += n
        assert dict(zip(often.keys.tolist(), often.counts.tolist(), strict=True)) == plain
    few = Often(most=3)
    few.add(np.array([1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5], np.uint64))
    few.settle()
    assert few.keys.tolist() == [1, 5]


def test_rows_of_bits_lose_no_link_and_pass_over_the_rest():
    rng = np.random.default_rng(5)
    boiler = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets, family = [], []
    for f, n in enumerate([3, 9, 16, 17, 31, 33, 60, 64, 66, 120, 130, 250, 260, 500, 520, 3000]):
        base = np.append(boiler, rng.integers(0, 2**63, n).astype(np.uint64))
        for gone in (0, 0.02, 0.05, 0.08, 0.1, 0.16):  # about the threshold, on both sides of a doubled width
            sets.append(np.unique(np.append(base[rng.random(len(base)) >= gone], rng.integers(0, 2**63, 2).astype(np.uint64))))
            family.append(f)
    n, family = np.array([len(s) for s in sets]), np.array(family)
    rows, side = jaccard.bit_rows(np.concatenate(sets), n), np.arange(len(sets)) % 2
    assert len({len(r) for r in rows}) > 3 and sum(map(len, rows)) <= sum(n) * 8 / 16
    link = np.array([[i != j and jaccard._linked(len(np.intersect1d(a, b)), len(a), len(b), 85, 100) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    for one in (False, True):
        live = jaccard._live(side, n, rows, one, 85, 100)
        want = (link if one else link & (side[:, None] != side[None, :])).any(1)
        assert want.any() and live[want].all()
    apart = jaccard._live((family >= 14).astype(np.int64), n, rows, False, 85, 100)
    assert not apart[family == 15].any() and apart.sum() <= 12


def test_tables_and_shuffles_go_when_nothing_reads_them(spark):
    def tables():
        f = shared_folder(spark) + "/tables"
        return set(os.listdir(f.removeprefix("file://"))) if os.path.isdir(f.removeprefix("file://")) else set()

    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")

    before, shuffled = tables(), files()
    scratch.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert files() <= shuffled
    out = jaccard_join(docs_of(spark, corpus()), 4, 85, 100)
    assert {x.rsplit("-", 1)[0] for x in tables() - before} <= {"few", "profiles", "classes", "edges"}
    assert {tuple(r) for r in out.collect()} == brute(corpus(), 4, 85, 100)


def test_texts_taken_apart_in_pieces_give_the_same_sets(monkeypatch):
    texts = pa.array(corpus()).fill_null("")
    want = jaccard.shingle_sets(texts, 4)
    for piece in (1, 700, 10**9):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        for got in (jaccard.shingle_sets(texts, 4), jaccard.shingle_sets(texts.slice(3, 40), 4)):
            assert len(got[1]) == got[2].sum()
        assert all((x == y).all() for x, y in zip(jaccard.shingle_sets(texts, 4), want, strict=True))
    assert [len(x) for x in jaccard.shingle_sets(texts.slice(0, 0), 4)] == [0, 0, 0]
