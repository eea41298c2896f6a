import os
import random
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import census, checks, closure, dedup, documents, freshness, logs, paths, refs, rows, stats
from tallyforge.plans import catalogue
from tallyforge.sources import readers, sinks
from tallyforge.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(catalogue.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == names

    def key(values):
        return tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in values)

    assert sorted(key(r[c] for c in names) for r in got.collect()) == sorted(key(r[at[c]] for c in names) for r in want.fetchall())


def test_counted_union_is_a_bag_difference(spark):
    rng = random.Random(1)
    for _ in range(4):
        live = [(i, rng.choice("abc") if rng.random() < 0.9 else None) for i in range(40)]
        seat = [(i, rng.choice("abc")) for i in range(rng.randrange(0, 20))]
        a, b = (spark.createDataFrame(x, "pos int, line string") for x in (live, seat))
        got = [r.line for r in logs.counted_extras(a, b, ["line"], "pos").orderBy("pos").collect()]
        left, want = [x for _, x in seat], []
        for _, x in live:
            if x in left:
                left.remove(x)
            else:
                want.append(x)
        assert got == want


def test_thread_rule_against_row_at_a_time(spark):
    rng = random.Random(3)
    th, src, dst, want = [], [], [], {}
    for t in range(150):
        winner = rng.choice(["source", "dest", "same"])
        th.append((t, winner))
        d = {k: (rng.randrange(4) if rng.random() < 0.8 else None, rng.choice("xy")) for k in range(6) if rng.random() < 0.5}
        s = [(k, rng.randrange(4) if rng.random() < 0.8 else None, rng.choice("xy")) for k in range(6) if rng.random() < 0.7]
        dst += [(t, k, o, b) for k, (o, b) in d.items()]
        held = False
        for i, (k, o, b) in enumerate(s):
            src.append((t, k, o, b, i))
            if not held and k not in d and winner in ("source", "dest") and o is not None and any(x[0] == o for x in d.values()):
                held = True
            if held:
                want[t, i] = "held"
            elif k not in d:
                want[t, i] = "insert"
                d[k] = (o, b)
            elif d[k] == (o, b):
                want[t, i] = "adopt"
            elif winner == "source":
                want[t, i] = "replace"
                d[k] = (o, b)
            else:
                want[t, i] = "hold"
    got = rows.union_threads(
        spark.createDataFrame(th, "t int, winner string"), spark.createDataFrame(src, "t int, k int, o int, body string, at int"), spark.createDataFrame(dst, "t int, k int, o int, body string"), "t", ["k"], "o", "at"
    )
    assert {(r.t, r["at"]): r.outcome for r in got.collect()} == want


def test_natural_union_keeps_or_ledgers_every_value(spark):
    s = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (None, "n", 1), (4, "x", None), (5, "same", 1)], "id int, v string, ver int")
    d = spark.createDataFrame([(1, "A", 1), (2, "B", 1), (None, "n", 1), (4, "X", 3), (6, "only", 1), (5, "same", 1)], "id int, v string, ver int")
    got = {r.id: (r.action, r.reason, r.kept.v, r.lost and r.lost.v) for r in rows.union_natural(s, d, ["id"], "ver").collect()}
    assert got == {
        1: ("replace", "newer", "a", "A"), 2: ("hold", "same-version", "B", "b"), None: ("adopt", None, "n", None),
        4: ("hold", "unversioned", "X", "x"), 5: ("adopt", None, "same", None), 6: ("keep", None, "only", None),
    }


def test_interval_union_worked_values(spark):
    m = 256
    cases = {"mid": ([(2000, 2064)], 5000, 832), "near": ([(10, 20), (100, 110)], 5000, 622), "append": ([(4000, 4100)], 4100, 356), "empty": ([], 10, None)}
    data = [(k, a, b, size) for k, (r, size, _) in cases.items() for a, b in r]
    df = spark.createDataFrame(data, "k string, a int, b int, size int")
    got = {r.k: r.covered for r in stats.interval_union(df, ["k"], "a", "b", widen=(m, 2 * m), cap="size").collect()}
    assert got == {k: w for k, (_, _, w) in cases.items() if w is not None}


def test_ranked_values_use_the_rounded_rank(spark):
    rng = random.Random(2)
    v = [rng.randrange(50) for _ in range(301)] + [None]
    got = {r.q: r.value for r in census.ranked_values(spark.createDataFrame([(x,) for x in v], "v int"), "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    s = sorted(x for x in v if x is not None)
    assert got == {q: s[int(q * (len(s) - 1) + 0.5)] for q in got} and len(got) == 5


def test_buckets_close_on_the_right(spark):
    df = spark.createDataFrame([(10,), (11,), (20,), (21,), (None,)], "v int")
    assert [r.b for r in df.select(census.bucket(F.col("v"), [10, 20]).alias("b")).collect()] == [10, 20, 20, None, None]


def test_chunks_cover_and_survive_insertions():
    data = random.Random(5).randbytes(60_000)
    ends = dedup.cuts(data, 256, 1024, 4096)
    assert ends[-1] == len(data) and all(b - a <= 4096 for a, b in zip([0, *ends], ends, strict=False))
    cut = lambda d: {d[a:b] for e in [dedup.cuts(d, 256, 1024, 4096)] for a, b in zip([0, *e], e, strict=False)}
    assert len(cut(data) & cut(data[:30_000] + b"inserted" + data[30_000:])) > 0.9 * len(cut(data))
    assert dedup.cuts(b"", 256, 1024, 4096) == []


def test_manifest_refusals(spark):
    m = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 0), (2, 0, "a", 5), (3, 0, "c", 4), (4, 0, "d", 3), (5, 0, "d", 4)], "doc_id int, pos int, digest string, size int")
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 3), (5, 4)], "doc_id int, size int")
    assert {r.doc_id: r.reason for r in dedup.manifest_refusals(m, sizes).collect()} == {1: "chunk-size", 3: "sum", 4: "two-sizes", 5: "two-sizes"}


def test_documents_merge(spark):
    live = '{"a": {"x": 1, "y": [1, 2, 2]}, "b": true, "k": "l"}'
    source = '{"a": {"x": 1.0, "y": [2, 3, 3], "z": null}, "b": 1, "k": "s"}'
    df = spark.createDataFrame([(1, live, source, True), (2, live, source, False), (3, "no json", source, True), (4, None, None, True)], "id int, live string, source string, source_later boolean")
    got = {r.id: r for r in documents.merge_documents(df, "id").collect()}
    assert got[1].merged == '{"a": {"x": 1, "y": [1, 2, 2, 3], "z": null}, "b": 1, "k": "s"}' and got[1].lost == '[["/b", "live", true], ["/k", "live", "l"]]'
    assert got[2].merged == '{"a": {"x": 1, "y": [1, 2, 2, 3], "z": null}, "b": true, "k": "l"}'
    assert got[3].merged == source and got[4].merged is None
    assert documents.pointer("a/b", "~") == "/a~1b/~0"
    one = spark.createDataFrame([('{"b": 1, "a": 2, "ordinal": 7}',), ('{"ordinal": 8, "a": 2, "b": 1}',)], "t string").select(documents.canonical(F.col("t")).alias("c"))
    assert one.distinct().count() == 1


def test_longest_prefix_and_overlap(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",), ("a",)], "p string")
    m = spark.createDataFrame([("a", "1"), ("a/b", "2")], "owner string, target string")
    got = {r.p: r.m for r in paths.owners(p, "p", m).select("p", paths.mapped(F.col("p"), F.col("owner"), F.col("target")).alias("m")).collect()}
    assert got == {"a/b/c": "2/c", "a/bc": "1/bc", "x": "x", "a": "1"}


def test_gate_and_attestations(spark):
    d = spark.createDataFrame([(1, "done"), (2, "unaccounted")], "item int, disposition string")
    assert closure.gate(d).first().passed is False
    assert closure.gate(d.where("item = 1")).first().passed is True


def test_racy_rows(spark):
    df = spark.createDataFrame([(5,), (9,), (10,), (30,)], "t int")
    assert [r.r for r in df.select(freshness.racy(F.col("t"), F.lit(10), 1, F.lit(20)).alias("r")).collect()] == [False, True, True, True]


def test_seat_state_never_multiplies(spark):
    r = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "dev int, ino int")
    held = spark.createDataFrame([(1, 1), (1, 1), (None, 3)], "dev int, ino int")
    assert [x.state for x in freshness.seat_state(r, held, ["dev", "ino"]).orderBy("ino").collect()] == ["fresh", "stale", "stale"]


def test_name_conflicts(spark):
    names = spark.createDataFrame([("a",), ("b/c",)], "name string")
    made = spark.createDataFrame([("a/x",), ("b",), ("d",), ("e/f",), ("e",)], "name string")
    assert {r.name for r in refs.name_conflicts(made, names).collect()} == {"a/x", "b", "e/f", "e"}


def test_dependency_order():
    assert rows.dependency_order(["c", "a", "b"], [("a", "b"), ("b", "c")]) == ["c", "b", "a"]
    assert sorted(rows.dependency_order(["x", "y"], [("x", "y"), ("y", "x")])) == ["x", "y"]


def test_byte_difference(spark):
    df = spark.createDataFrame([(1, b"abc", b"abc"), (2, b"abcd", b"axcx"), (3, b"ab", b"abcd"), (4, None, b"a")], "k int, a binary, b binary")
    assert {r.k: (r.first, r.last) for r in stats.byte_difference(df, "k").collect()} == {1: (None, None), 2: (1, 3), 3: (2, 3), 4: (0, 0)}


def test_sources(spark, tmp_path):
    import zstandard

    (tmp_path / "t/d").mkdir(parents=True)
    (tmp_path / "t/d/f.txt").write_text("hello")
    os.symlink("d", tmp_path / "t/l")
    readers.register(spark)
    tree = {bytes(r.path).decode(): (r.kind, r.size) for r in spark.read.format("filetree").load(str(tmp_path / "t")).collect()}
    assert tree["d/f.txt"] == ("regular", 5) and tree["d"][0] == "directory" and tree["l"][0] == "symlink" and len(tree) == 3
    with sqlite3.connect(tmp_path / "s.db") as c:
        c.execute("CREATE TABLE t (a TEXT, b INTEGER)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(f"v{i}", i) for i in range(100)])
    read = spark.read.format("sqlitetable").option("table", "t").option("parts", "3")
    assert sorted((r.a, r.b) for r in read.load(str(tmp_path / "s.db")).collect()) == sorted((f"v{i}", i) for i in range(100))
    assert read.option("after_rowid", "90").load(str(tmp_path / "s.db")).count() == 10
    (tmp_path / "a.jsonl").write_bytes(b'{"x":1}\n{"x":2}\nhalf')
    (tmp_path / "b.jsonl").write_bytes(zstandard.compress(b"one\ntwo\n"))
    got = sorted((r.path.rsplit("/", 1)[1], r.pos, r.line, r.whole) for r in readers.json_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).collect())
    assert got == [("a.jsonl", 0, '{"x":1}', True), ("a.jsonl", 1, '{"x":2}', True), ("a.jsonl", 2, "half", False), ("b.jsonl", 0, "one", True), ("b.jsonl", 1, "two", True)]
    kv = readers.key_values(spark.createDataFrame([("a=1 b=unknown c x=y=z",)], "l string"), "l").first().values
    assert kv == {"a": "1", "b": None, "x": "y=z"}


def test_stream_is_read_once_and_sinks_do_not_clobber(spark, tmp_path):
    schema = "k int, v int"
    src, out, log = (f"file://{tmp_path}/{n}" for n in ("src", "out", "log"))
    spark.createDataFrame([(1, 1), (1, 2), (2, 5)], schema).write.parquet(f"{src}/a")
    stream = lambda: incremental.read_growing(spark, src, spark.createDataFrame([], schema).schema)
    incremental.upsert_batches(stream(), out, log, ["k"], "v")
    spark.createDataFrame([(1, 9), (3, 3)], schema).write.parquet(f"{src}/b")
    incremental.upsert_batches(stream(), out, log, ["k"], "v")
    incremental.upsert_batches(stream(), out, log, ["k"], "v")
    assert sorted((r.k, r.v) for r in incremental.merged(spark, out, ["k"], "v").collect()) == [(1, 9), (2, 5), (3, 3)]
    df = spark.createDataFrame([(1, 1)], schema)
    sinks.publish(df, f"{tmp_path}/pub")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, f"{tmp_path}/pub")
    assert sinks.upserted(df, spark.createDataFrame([(1, 5), (2, 0)], schema), ["k"], "v").count() == 2


def test_ancestry_has_no_depth(spark):
    edges = [(i, i + 1) for i in range(54)] + [(i + 1, i) for i in (100, 101)] + [(100, 102), (5, None), (None, 5), (0, 1)]
    got = {(r.child, r.ancestor): r.steps for r in refs.ancestry(spark.createDataFrame(edges, "child int, parent int")).collect()}
    want = {(i, j): j - i for i in range(55) for j in range(i + 1, 55)}
    # a ring: 101 -> 100 -> 102 -> 101
    want |= {(a, b): n for x in ((101, 100, 102),) for i, a in enumerate(x) for n, b in ((1, x[(i + 1) % 3]), (2, x[(i + 2) % 3]), (3, a))}
    assert got == want


def test_racy_rows_wait_for_a_later_pass(spark, tmp_path):
    schema = "k int, v int, t int"
    src, out, log = (f"file://{tmp_path}/{n}" for n in ("src", "out", "log"))
    stream = lambda: incremental.read_growing(spark, src, spark.createDataFrame([], schema).schema)
    seen = lambda: sorted((r.k, r.v) for r in incremental.merged(spark, out, ["k"], "v").collect())
    spark.createDataFrame([(1, 1, 5), (1, 2, 11), (2, 5, 12), (3, 1, None), (4, 1, 25)], schema).write.parquet(f"{src}/a")
    incremental.upsert_batches(stream(), out, log, ["k"], "v", "t >= 10")
    assert seen() == [(1, 1), (3, 1)]
    spark.createDataFrame([(2, 4, 3)], schema).write.parquet(f"{src}/b")
    incremental.upsert_batches(stream(), out, log, ["k"], "v", "t >= 20")
    assert seen() == [(1, 2), (2, 5), (3, 1)]
    incremental.upsert_batches(stream(), out, log, ["k"], "v")
    assert seen() == [(1, 2), (2, 5), (3, 1), (4, 1)]


def test_whole_queries_read_all_windows_and_lines(spark):
    run = {n: catalogue.queries()[n](spark, SF) for n in ("window_location_all", "overlap_fraction_all", "pair_verdict_all")}
    t = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    assert run["overlap_fraction_all"].count() == t("part").where("p_size > 0").count()
    assert run["window_location_all"].where("name % 10 <> 0").count() > 0
    verdicts = {}
    for r in t("lineitem").select("l_suppkey", (F.col("l_quantity") > F.expr("case l_suppkey % 9 when 0 then 0 when 1 then 50 else 49 end")).alias("bad")).collect():
        verdicts.setdefault(r.l_suppkey, set()).add(r.bad)
    assert {r.l_suppkey: r.verdict for r in run["pair_verdict_all"].collect()} == {k: "INCONCLUSIVE" if len(v) > 1 else "FAIL" if v.pop() else "PASS" for k, v in verdicts.items()}


def test_load_of_a_hot_group_needs_no_array(spark):
    rng = random.Random(4)
    data = [(rng.choice("aaaaab"), i, rng.random()) for i in range(4000)] + [("c", 1, None), (None, 1, 2.0)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "u string, t int, v double")
    want = {}
    for u, _, v in data:
        if v is not None:
            want[u] = want.get(u, 0.0) * 0.999 + v * 0.001
    out = checks.ewma(df, "u", "t", "v", 0.999)
    got = {r.u: r.load for r in out.collect()}
    assert got.pop("c") is None and set(got) == set(want) and all(abs(got[u] - want[u]) < 1e-9 for u in want)
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "rangepartitioning" in plan


BRANCHES = {
    "sidecar_pairing": ("base is null", {True, False}), "key_map_unique": ("usable", {True, False}), "coverage_verdict": ("verdict", {"covered", "extends", "lacks"}),
    "attest_buckets": ("bucket", {"foreign", "rejected", "accepted", "superseded", "disagreement"}), "pair_verdict": ("verdict", {"PASS", "FAIL", "INCONCLUSIVE"}),
}


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_each_branch_has_rows(spark, name):
    what, want = BRANCHES[name]
    assert {r.x for r in catalogue.queries()[name](spark, "/root/testdata/sf0.01").selectExpr(f"{what} as x").distinct().collect()} == want


def test_equal_rows_keep_their_number_in_windows(spark):
    r = spark.createDataFrame([(5, "a"), (5, "a"), (None, "b")], "t int, x string")
    w = spark.createDataFrame([(0, 10, "w")], "start int, end int, name string")
    assert [(x.t, x.x, x.name) for x in checks.in_window(r, w, "t", 4).collect()] == [(5, "a", "w")] * 2


def test_a_repeated_key_takes_its_last_value(spark):
    assert readers.key_values(spark.createDataFrame([("a=1 b=2 a=3",)], "l string"), "l").first().values == {"a": "3", "b": "2"}


def test_canonical_keeps_types_and_sorts_all_objects(spark):
    t = ['{"a": {"y": 1, "x": 2}, "ordinal": 3}', '{"a": {"x": 2, "y": 1}}', '{"a": {"x": 2, "y": "1"}}', "no json", None]
    got = [r.c for r in spark.createDataFrame([(x,) for x in t], "t string").select(documents.canonical(F.col("t")).alias("c")).collect()]
    assert got[0] == got[1] != got[2] and got[3:] == ["raw:no json", None]


def test_outcomes_of_one_item_that_differ_are_refused(spark):
    plan = spark.createDataFrame([(1,), (2,), (2,)], "item int")
    out = spark.createDataFrame([(1, 7, "done", None), (1, 7, "held", None), (2, 8, "done", None), (2, 8, "done", None)], "item int, instance int, state string, code string")
    none = spark.createDataFrame([], "scope string, item int, instance int, code string, decision string, seq int")
    assert sorted((r.item, r.disposition, r.code) for r in closure.dispositions(plan, out, none).collect()) == [(1, "refused-pending-review", "DUPLICATE_OUTCOME"), (2, "done", None)]


def test_overlaps_give_one_owner_for_each_root(spark):
    r = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a/b"), (5, "c")], "id int, root string")
    assert sorted(map(tuple, paths.overlaps(r).collect())) == [(2, 1), (3, 1), (4, 1)]


def test_an_unreadable_root_is_a_refusal(spark, tmp_path):
    readers.register(spark)
    assert [r.refusal for r in spark.read.format("filetree").load(str(tmp_path / "none")).collect()] == ["io:2"]


def test_bootstrap_draws_windows_then_blocks_and_takes_p95(spark):
    import math
    from collections import defaultdict

    g = random.Random(3)
    rows = [("a", s, w, b, float(g.randrange(1, 40))) for s in ("on", "off") for w in range(4) for b in range(1 + w % 3) for _ in range(g.randrange(1, 30))]
    rows += [("lone", "on", 0, 0, 1.0), ("a", "on", 1, None, 5.0), ("a", "on", 1, 0, None)]
    samples = spark.createDataFrame(rows, "g string, state string, window int, block int, value double")
    whole = samples.dropna()
    draws = stats.block_draws(whole, "g", 60)
    got = {(r.g, r.state, r.replicate): r.p95 for r in stats.replicate_p95(whole, draws, "g").collect()}
    values, drawn, picks = defaultdict(list), defaultdict(list), defaultdict(lambda: defaultdict(int))
    for k, s, w, b, v in rows:
        if b is not None and v is not None:
            values[k, s, w, b].append(v)
    for r in draws.collect():
        drawn[r.g, r.state, r.replicate] += values[r.g, r.state, r.window, r.block] * r.times
        picks[r.g, r.state, r.replicate][r.window] += r.times
    plain = {k: sorted(v)[math.ceil(0.95 * len(v)) - 1] for k, v in drawn.items()}
    assert got == plain and len(plain) == 180
    for (k, s, _), per in picks.items():
        assert sum(n / (1 + w % 3) for w, n in per.items()) == (4 if k == "a" else 1)
    assert len({tuple(sorted(p.items())) for key, p in picks.items() if key[0] == "a"}) > 20

    levels = spark.createDataFrame([("a", s, w, float(w + 10 * (s == "on")), 1 + w) for s in ("on", "off") for w in range(4)], "g string, state string, window int, level double, n long")
    out = {r.g: r for r in stats.bootstrap(samples, levels, "g", 0.05, 60).collect()}
    ratios = sorted(plain["a", "on", i] / plain["a", "off", i] - 1 for i in range(60))
    load = {}
    for i in range(60):
        for s in ("on", "off"):
            per = {w: n / (1 + w % 3) * (1 + w) for w, n in picks["a", s, i].items()}
            load[s, i] = sum(x * (w + 10 * (s == "on")) for w, x in per.items()) / sum(per.values())
    loads = sorted(load["on", i] - load["off", i] for i in range(60))
    assert (out["a"].p95_low, out["a"].p95_high) == (ratios[2], ratios[56])
    assert abs(out["a"].load_low - loads[2]) < 1e-9 and abs(out["a"].load_high - loads[56]) < 1e-9
    assert out["lone"].p95_low is None and out["lone"].load_high is None
