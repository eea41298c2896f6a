"""Ancestry and have/want against plain versions; logs, tokens and names that an earlier version got wrong."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks, closure, history, listings, logs, scalars


def closed(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    def above(n):
        seen, todo = set(), [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    return above


@pytest.mark.parametrize("seed", range(3))
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    edges = [(i, rng.randrange(max(0, i - 9), i)) for i in range(1, 120) if rng.random() < 0.9] + [(i, rng.randrange(i)) for i in rng.sample(range(2, 120), 12)]
    above = closed(edges)
    asked = [(rng.randrange(125), rng.randrange(125)) for _ in range(400)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3), (4, None)], "child int, parent int")
    h = history.index(df)
    got = {tuple(r) for r in history.above(h, spark.createDataFrame(asked, "child int, ancestor int")).collect()}
    assert got == {(a, b) for a, b in asked if b in above(a)}
    wanted, offered = rng.sample(range(125), 6), rng.sample(range(140), 9)
    sent = {r.node for r in history.have_want(df, spark.createDataFrame([(x,) for x in wanted], "node int"), spark.createDataFrame([(x,) for x in offered], "node int")).collect()}
    nodes = {x for e in edges for x in e} | set(wanted)
    held = {x for x in offered if x in nodes}
    have = held | {y for x in held for y in above(x)}
    needed = set(wanted) - held
    assert sent == (needed | {y for x in needed for y in above(x)}) - have


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    h = history.index(spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent")))
    asked = spark.createDataFrame([(n - 1, 0), (0, n - 1), (n - 1, n - 2), (5000, 4999), (4999, 5000), (7, 7), (n, 3)], "child long, ancestor long")
    assert {tuple(r) for r in history.above(h, asked).collect()} == {(n - 1, 0), (n - 1, n - 2), (5000, 4999)}
    # a row for each node and doubling, never one for each pair
    assert len(h.up) == 14 and sum(u.count() for u in h.up) < 14 * n


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        history.index(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child int, parent int"))


def test_counted_extras_keep_every_row_of_a_wide_log(spark):
    live = spark.range(0, 60_000, 1, 16).select(F.col("id").alias("pos"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("l"), F.col("id") % 5)).alias("line"), F.repeat(F.lit("payload "), 60).alias("payload"))
    seat = spark.range(0, 3000).select(F.when(F.col("id") % 3 > 0, "l1").alias("line"), F.col("id").alias("pos"))
    got = logs.counted_extras(live, seat, ["line"], "pos").groupBy("line").agg(F.count("*").alias("n"), F.min("pos").alias("first")).collect()
    want = {r.line: r.n for r in live.groupBy("line").agg(F.count("*").alias("n")).collect()}
    left = {r.line: r.n for r in got}
    assert left == {k: n - {"l1": 2000, None: 1000}.get(k, 0) for k, n in want.items()}
    # the first ones are used up
    assert {r.line: r["first"] for r in got}[None] == 7000


def test_number_tokens_of_any_length(spark):
    tokens = {"0b" + "1" * 16: 65535, "0xffffffffffffffff": 2**64 - 1, "0o" + "7" * 16: 8**16 - 1, "-0x" + "7" * 31: -int("7" * 31, 16), "9" * 38: 10**38 - 1, "0" * 50 + "7": 7, "0b" + "1" * 126: 2**126 - 1, "1__0": 10, "0x": None, "0x" + "f" * 40: None, "": None}
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", scalars.integer_token(F.col("t")).alias("v")).collect()
    assert {r.t: None if r.v is None else int(r.v) for r in got} == tokens


def test_tracking_names(spark):
    names = {"refs/heads/a/b": "refs/remotes/s/a/b", "refs/tags/v": "refs/remotes/s/tags/v", "other": "refs/remotes/s/other", "refs/heads/": "refs/remotes/s/"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", checks.tracking_name(F.col("n"), "s").alias("t")).collect()
    assert {r.n: r.t for r in got} == names


def test_asides_by_tag_or_label(spark):
    names = ["f", "f.txt", "f.host-2026.01", "f.old", "f.older", "f.txt.old", "g.old", "f.host-1.host-2"]
    got = listings.asides(spark.createDataFrame([("d", n) for n in names], "dir string, name string"), ["host"], "old").collect()
    assert sorted((r.name, r.aside) for r in got) == [("f", "f.host-1.host-2"), ("f", "f.host-2026.01"), ("f", "f.old"), ("f.txt", "f.txt.old")]


def test_unknown_bytes_fail_the_gate(spark):
    schema = "run string, arm string, phase string, ms int, transferred long, source_read long, rss_kib long, gated boolean"
    base = [("ours", "initial", 1, 0, 0, 5, True), ("theirs", "initial", 2, None, None, 5, True), ("ours", "delta", 1, 0, 0, 5, True), ("theirs", "delta", 2, None, None, 5, True)]
    runs = {"pass": [], "unknown": [("ours", "warm-resume", 1, 0, None, 5, True)], "interrupted": [("ours", "interrupted-resume", 1, 3, 0, 5, True)], "large": [("ours", "delta", 1, 0, 0, 1 << 21, True)], "free": [("theirs", "delta", 2, 0, 0, 5, False)], "theirs": [("theirs", "warm-resume", 1, 9, 9, 1 << 30, True)]}
    got = {r.run: r.verdict for r in listings.bench_gate(spark.createDataFrame([(n, *row) for n, more in runs.items() for row in base + more], schema), "run").collect()}
    assert got == {"pass": "PASS", "unknown": "FAIL", "interrupted": "FAIL", "large": "FAIL", "free": "INFORMATIONAL", "theirs": "PASS"}


def test_nulls_count_in_digests_and_identity(spark):
    rows = spark.createDataFrame([("a", 1, None), ("z", 1, ""), ("b", 1, "~")], "k string, o int, v string")
    assert len({r.root for r in listings.folded(rows, "k", "o", "v").collect()}) == 3
    one = spark.range(0, 5000).withColumn("v", F.col("id") % 3)
    root = listings.identity(one, "id", 8, "v").first().root
    assert listings.identity(one.repartition(7), "id", 8, "v").first().root == root != listings.identity(one.where("id <> 77"), "id", 8, "v").first().root
    assert listings.identity(one.limit(0), "id", 8, "v").first().root == listings.identity(one.where("id < 0"), "id", 8, "v").first().root


def test_untyped_refusals_are_unaccounted(spark):
    plan = spark.createDataFrame([(i,) for i in range(4)], "item int")
    out = spark.createDataFrame([(0, 1, "refused", "IO"), (1, 1, "refused", "FRAME_CODEC"), (2, 1, "refused", "NO_CLOBBER"), (3, 1, "refused", "TRANSPORT_LOST")], "item int, instance int, state string, code string")
    reviews = spark.createDataFrame([("policy", None, None, "IO", "accept", 1)], "scope string, item int, instance int, code string, decision string, seq int")
    assert {r.item: r.disposition for r in closure.dispositions(plan, out, reviews).collect()} == {0: "unaccounted", 1: "unaccounted", 2: "refused-pending-review", 3: "unaccounted"}
    twice = spark.createDataFrame([(1, "s")] * 2, "item int, source string")
    with pytest.raises(ValueError, match="twice"):
        closure.attestations(plan, twice, plan)


def test_places_of_asked_nodes_only_and_both_sides_in_one_pass(spark):
    edges = spark.range(1, 3000).selectExpr("id as child", "id div 2 as parent").union(spark.range(8, 3000, 8).selectExpr("id", "id div 3")).union(spark.createDataFrame([(5, 2), (None, 1)], "child long, parent long"))
    tips = spark.createDataFrame([(2999, 1), (2998, 2), (None, 2), (-7, 2), (99999, 1), (2999, 1)], "node long, level int")
    h = history.index(edges, ranked=False, of=tips)
    assert h.places.count() < 1200 and h.places.count() == h.places.select("node").distinct().count()
    got = [tuple(r) for r in history.reached(h, tips).collect()]
    above = closed({(i, i // 2) for i in range(1, 3000)} | {(i, i // 3) for i in range(8, 3000, 8)})
    held = {2998, -7} | above(2998)
    assert len(got) == len(dict(got)) and dict(got) == {n: 1 for n in {2999, 99999} | above(2999)} | dict.fromkeys(held, 2)
