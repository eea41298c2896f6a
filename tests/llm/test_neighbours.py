import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import neighbours
from tallyforge.llm.neighbours import Router, balanced_parts, graph, nearest, others, probes_for


def brute(x, ids, queries, k):
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x * x[i]).sum(1) / (norm * norm[i])
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != i][:k]
    return out


def table(spark, x, ids, extra=()):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("x")).withColumn("v", F.lit(1))


def test_recall_scores_and_ties(spark):
    g = np.random.default_rng(2)
    centres = g.normal(0, 1, (30, 16))
    x = (centres[g.integers(0, 30, 3000)] + g.normal(0, 0.7, (3000, 16))).astype(np.float32)
    x[1000:1400] = x[50]  # one very common vector
    ids = g.permutation(5000)[:3000] * 2
    bad = [(10001, None), (10003, [0.0] * 16), (10005, [float("nan")] * 16), (10007, [1.0] * 3), (10009, [None] * 16), (None, [1.0] * 16), (10011, [float("inf")] * 16)]
    df = table(spark, x, ids, bad)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, least_sample=1250, sample_a_part=16, rows_a_part=300, block=500).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = x.astype(np.float64)
    want = brute(x, ids, [int(i) for i in ids if i % 20 == 0], 5)
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hit / (5 * len(want)) >= 0.95
    for q, ranks in got.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        row = [ranks[i] for i in range(1, 6)]
        assert row == sorted(row, key=lambda r: (-r[1], r[0]))
        assert all(i != q and i < 10000 for i, _ in row)
        for i, s in row:
            a, b = x[ids == q][0], x[ids == i][0]
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    same = [q for q in want if (x[ids == q][0] == x[50]).all()]
    assert same and all([got[q][i] for i in range(1, 6)] == want[q] for q in same)


def test_few_rows_and_none(spark):
    x = np.eye(3, 4, dtype=np.float32)
    got = nearest(table(spark, x, np.array([0, 50, 7])), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 7), (0, 2, 50), (50, 1, 0), (50, 2, 7)]
    assert nearest(table(spark, x, np.array([0, 50, 7])).limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest(table(spark, x[:1], np.array([0])), F.col("vec_id") % 50 == 0).collect() == []


def test_large_and_tiny_components_and_repeated_ids(spark):
    rows = [(0, [1e200, 1e200]), (50, [1e-200, -1e-201]), (7, [3.0, 4.0]), (7, [4.0, 3.0]), (None, [1.0, 1.0]), (100, [1e300, 0.0])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = [(0, (1, 1)), (50, (10, -1)), (7, (3, 4)), (7, (4, 3)), (100, (1, 0))]
    for q, v in ((0, (1, 1)), (50, (10, -1)), (100, (1, 0))):
        want = sorted(((-(v[0] * w[0] + v[1] * w[1]) / (np.hypot(*v) * np.hypot(*w)), i) for i, w in x if i != q))
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(-c)) for c, i in want]


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(0, 1, (999, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = balanced_parts(x, graph(x, 5), 7)
    assert np.ptp(np.bincount(part, minlength=7)) <= 4


def test_probes_hold_for_rows_the_router_has_not_seen():
    g = np.random.default_rng(4)
    x = g.normal(0, 1, (3500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit, held, fresh = x[:2000], x[2000:2500], x[2500:]
    part = balanced_parts(unit, graph(unit, 10), 30)
    net = Router(12, 30).fit(unit, part)
    home = net.score(unit).argmax(1)
    probes = probes_for(home, others(held, unit, 10), held, net, 0.9)
    order = np.argsort(-net.score(fresh), axis=1)[:, :probes]
    found = (home[others(fresh, unit, 10)][:, :, None] == order[:, None, :]).any(2).mean()
    assert 0.87 <= found and probes < 30


def test_neighbours_of_many_rows_hold_one_block_at_a_time():
    g = np.random.default_rng(6)
    x, asking = g.normal(0, 1, (12_000, 8)), g.normal(0, 1, (4000, 8))
    tracemalloc.start()
    try:
        got = others(asking, x, 10)
        near = graph(x[:3000], 10)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 5 * neighbours.BLOCK_BYTES  # all blocks together hold 384 MB
    want = np.argsort(-(asking[:50].astype(np.float32) @ x.astype(np.float32).T), axis=1)[:, :10]
    assert (np.sort(got[:50]) == np.sort(want)).all()
    sim = x[:3000].astype(np.float32) @ x[:3000].astype(np.float32).T
    np.fill_diagonal(sim, -2e9)
    assert (np.sort(near) == np.sort(np.argsort(-sim, axis=1)[:, :10])).mean() > 0.99


def test_shelves_of_several_parts_and_blocks_change_nothing(spark, monkeypatch):
    g = np.random.default_rng(7)
    x = (g.normal(0, 1, (20, 12))[g.integers(0, 20, 2000)] + g.normal(0, 0.5, (2000, 12))).astype(np.float32)
    x[300:420] = x[5]
    df = table(spark, x, np.arange(2000))
    got = []
    for least, block in ((24, None), (3, None), (1, 150)):
        monkeypatch.setattr(neighbours, "LEAST_SHELVES", least)
        got.append({tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, least_sample=800, sample_a_part=16, rows_a_part=150, block=block).collect()})
    assert len(got[0]) == 500 and got[0] == got[1] == got[2]
