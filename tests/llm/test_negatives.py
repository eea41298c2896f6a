"""Operator 13 against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.negatives import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score string"


def plain(rows, asks, positives=5, k=10, low=30, high=90):
    use = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, lab, v) in enumerate(use):
        if not asks(a):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, other) for m, (i, other, w) in enumerate(use) if m != n]
        for s, p, _ in sorted((x for x in scored if x[2] == lab), key=lambda x: x[:2])[:positives]:
            fits = sorted((x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s), key=lambda x: x[:2])[:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, asks, **k):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), asks, **k).collect())


@pytest.mark.parametrize(("parts", "anchors"), [(1 << 22, 1024), (40 * 6, 3), (7 * 6, 1)])
def test_equals_a_plain_version(spark, parts, anchors):
    rng = random.Random(2)
    rows = [(i * 5, rng.randrange(3), [rng.choice([-0.5, 0.1, 0.25, 0.7, 1.0, rng.random()]) for _ in range(6)]) for i in range(240)]
    rows += [(20_000 + i * 10, 1, rows[4][2]) for i in range(40)]  # one vector many times
    rows += [(7, None, [1.0] * 6), (8, 1, None), (10, 1, [1.0, None] * 3), (30, 1, [float("nan")] * 6), (40, 0, [float("inf")] * 6), (None, 1, [1.0] * 6), (50_000, 2, []), (50_010, 2, [2.0, 1.0])]
    got = mined(spark, rows, F.col("vec_id") % 10 == 0, parts=parts, anchors=anchors)
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_labels_first_and_negative_scores(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    changed = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    assert mined(spark, rows, F.col("vec_id") % 3 == 0, label=label, positives=20, k=4) == plain(changed, lambda i: i % 3 == 0, positives=20, k=4)


def test_large_components_are_exact(spark):
    rows = [(0, 0, [3e6, 1.0]), (1, 0, [3e6, 2.0]), (2, 0, [3e6, 3.0]), (3, 1, [1.5e6, 1.0]), (4, 1, [1.5e6, 2.0]), (5, 1, [2.7e6, 0.0]), (6, 1, [2.7e6, 4.0])]
    assert mined(spark, rows, F.col("vec_id") == 0) == plain(rows, lambda i: i == 0)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, 0, [1.0, 0.0]), (0, 0, [1.0, 0.5]), (1, 0, [0.9, 0.1]), (2, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5])]
    assert mined(spark, rows, F.col("vec_id") == 0) == plain(rows, lambda i: i == 0)


def test_nothing_to_mine(spark):
    assert mined(spark, [], F.col("vec_id") == 0) == []
    assert mined(spark, [(1, 0, [1.0])], F.col("vec_id") == 0) == []
    assert mined(spark, [(0, 0, [1.0]), (1, 1, [1.0])], F.col("vec_id") == 0) == []
