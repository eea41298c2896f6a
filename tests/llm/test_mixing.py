import random
from collections import defaultdict

from helpers import SCHEMA, prose, words
from pyspark.sql import functions as F

from tallyforge.llm.mixing import mix_plan, mixed_texts, permuted, shard_counts


def reshared(size, weights=(5, 2, 1)):
    """Targets by sharing again and again, as the contract words it."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total = sum(size.values())
    got, open_, left = {s: 0.0 for s in size}, set(size), float(total)
    while left > 1e-9 and open_:
        part = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            got[s] += part * weight[s]
            if got[s] >= 3 * size[s]:
                left += got[s] - 3 * size[s]
                got[s] = 3.0 * size[s]
                open_.discard(s)
    return got


def table(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(0, 90)), "en", rng.choice(["b", "b", "b", "a", "c", "É", None, "z"]), 0) for i in range(1500)]
    rows += [(5000, None, None, "a", None), (5001, "", None, None, 0), (5002, "  ", None, "only empty", 0), (5003, "w " * 5000, "en", "a", 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("size", F.lit(None).cast("string"))


def test_targets_counts_and_texts(spark):
    docs = table(spark)
    text = {r.doc_id: (r.source, words(r.text)) for r in docs.collect()}
    rows, placed = mix_plan(docs, block=16, shard_slots=100)
    got = {r.doc_id: r for r in rows.collect()}
    assert set(got) == set(text)
    size, taken = defaultdict(int), defaultdict(int)
    for i, (s, w) in text.items():
        size[s] += len(w)
        taken[s] += got[i].taken
        assert got[i].size == len(w) and got[i].taken <= 3 * len(w)
    want = reshared(size)
    for i, (s, _) in text.items():
        assert got[i].source_size == size[s]
        assert abs(got[i].target - want[s]) < 1e-6 * max(1, want[s])
    for s in size:
        assert abs(taken[s] - want[s]) <= 3 * 16 + 0.02 * want[s], s
    # the texts hold just the words taken
    seen = defaultdict(int)
    for r in mixed_texts(docs, rows, block=16).collect():
        seen[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in seen.items()} == {i: r.taken for i, r in got.items() if r.taken}
    # shards are full but for the last, and no block is used more than three times
    shards = [r["count"] for r in placed.groupBy("shard").count().orderBy("shard").collect()]
    assert set(shards[:-1]) == {100}
    assert placed.groupBy("rank", "index").count().agg(F.max("count")).first()[0] <= 3
    again, _ = mix_plan(docs.repartition(13).orderBy(F.rand(3)), block=16, shard_slots=100)
    assert {r.doc_id: r.taken for r in again.collect()} == {i: r.taken for i, r in got.items()}


def test_draw_is_near_multinomial(spark):
    plan = spark.createDataFrame([(0, 6000), (1, 3000), (2, 1000), (3, 0)], "rank int, slots long")
    got = shard_counts(plan, 500, 3).toPandas().pivot(index="shard", columns="rank", values="n").fillna(0)
    assert got.sum().to_dict() == {0: 6000, 1: 3000, 2: 1000}
    assert set(got.sum(axis=1)) == {500}
    # a multinomial count of 500 with p = 0.6 has 11; the last shards take what others drew too much or too little
    assert 4 < got[0][:-1].std() < 20


def test_permutations(spark):
    for n in (1, 2, 7, 1000):
        row = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        p = [r.p for r in row]
        assert sorted(p) == list(range(n))
    assert sum(abs(a - b) == 1 for a, b in zip(p, p[1:], strict=False)) < 20


def test_empty_table(spark):
    rows, _ = mix_plan(table(spark).limit(0))
    assert rows.collect() == []
