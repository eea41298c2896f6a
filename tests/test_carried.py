"""State between tables, passes and runs: thread winners, exactly-once inserts, versions, starvation."""

import datetime
import random
import threading

import pytest

from tallyforge.sources.versions import Occupied, Raced, VersionedTable
from tallyforge.streaming import carried, incremental


def one_row_at_a_time(winners, tables, dests):
    """winners: thread -> source, dest, same or held, changed in place; outcomes by (table, thread, order)."""
    want = {}
    for name, rows in tables.items():
        d = dests[name]
        for t, k, o, b, at in rows:
            w = winners[t]
            if w in ("source", "dest") and (t, k) not in d and o is not None and any(x[0] == o for (u, _), x in d.items() if u == t):
                w = winners[t] = "held"
            if w == "held":
                want[name, t, at] = "held"
            elif (t, k) not in d:
                want[name, t, at] = "insert"
                d[t, k] = (o, b)
            elif d[t, k] == (o, b):
                want[name, t, at] = "adopt"
            elif w == "source":
                want[name, t, at] = "replace"
                d[t, k] = (o, b)
            else:
                want[name, t, at] = "hold"
    return want


def test_held_threads_stay_held_over_tables_and_passes(spark):
    rng = random.Random(7)
    names, threads = ["turns", "items", "marks"], range(60)
    dests = {n: {(t, k): (rng.randrange(4) if rng.random() < 0.8 else None, rng.choice("xy")) for t in threads for k in range(4) if rng.random() < 0.4} for n in names}
    state = spark.createDataFrame([(0, "held"), (1, "held")], "t int, winner string")
    model = {t: "held" if t < 2 else None for t in threads}
    frames = {n: spark.createDataFrame([(t, k, o, b) for (t, k), (o, b) in d.items()], "t int, k int, o int, body string") for n, d in dests.items()}
    for _ in range(2):
        decided = {t: rng.choice(["source", "dest", "same"]) for t in threads}
        tables = {}
        for n in names:
            rows = [(t, k, rng.randrange(4) if rng.random() < 0.8 else None, rng.choice("xy")) for t in threads for k in range(5) if rng.random() < 0.4]
            tables[n] = [(*r, i) for i, r in enumerate(rows)]
        for t in threads:
            model[t] = "held" if model[t] == "held" else decided[t]
        state = carried.carried(state, spark.createDataFrame(list(decided.items()), "t int, winner string"), "t")
        source = {n: spark.createDataFrame(r, "t int, k int, o int, body string, at int") for n, r in tables.items()}
        out, state = carried.union_tables(state, [carried.ThreadTable(n, source[n], frames[n], ["k"], "o", "at") for n in names], "t")
        want = one_row_at_a_time(model, tables, dests)
        assert {(n, r.t, r["at"]): r.outcome for n in names for r in out[n].collect()} == want
        assert {r.t: r.winner for r in state.collect()} == model and "held" in set(want.values())
        for n in names:
            frames[n] = spark.createDataFrame(carried.applied(frames[n], out[n], ["t", "k"]).collect(), frames[n].schema)
            assert {(r.t, r.k): (r.o, r.body) for r in frames[n].collect()} == dests[n]


@pytest.mark.parametrize("phase", ["pending", "rows", None])
def test_every_row_is_inserted_once(spark, tmp_path, phase):
    table = carried.OnceInserted(spark, f"file://{tmp_path}", ["body", "n"])
    schema = "source string, ordinal long, body string, n int"
    first = spark.createDataFrame([("a", i, "same" if i % 2 else f"b{i}", None) for i in range(20)], schema)
    more = first.union(spark.createDataFrame([("b", i, "same", None) for i in range(5)], schema))
    assert table.insert(first) == 20
    if phase:
        with pytest.raises(RuntimeError):
            table.insert(more, fail_after=phase)
    assert table.insert(more) == (0 if phase == "rows" else 5)
    assert table.insert(more) == 0
    rows = table.rows(more.dtypes).collect()
    assert len(rows) == 25 and sorted(r.id for r in rows) == list(range(1, 26)) and sum(r.body == "same" for r in rows) == 15


def test_two_writers_lose_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}")
    assert table.version() == 0 and table.read() is None

    def add(name):
        for i in range(3):
            one = spark.createDataFrame([(f"{name}{i}",)], "v string")
            table.merge(lambda now, one=one: one if now is None else now.union(one), name, tries=40)

    writers = [threading.Thread(target=add, args=(n,)) for n in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.v for r in table.read().collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"] and table.version() == 6
    assert sorted(r.v for r in table.read(1).collect()) in (["a0"], ["b0"])


def test_only_own_untouched_versions_are_superseded(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}")
    one = spark.createDataFrame([(1,)], "v int")
    assert table.supersede(one, "me") == 1 and table.supersede(one, "me") == 2
    with pytest.raises(Occupied):
        table.supersede(one, "you")
    table.merge(lambda now: now, "you")
    with pytest.raises(Occupied):
        table.supersede(one, "me")

    def meddled(now):
        table.commit(one, table.version(), "other")
        return now

    with pytest.raises(Raced):
        table.merge(meddled)
    assert table.version() == 3 + 4


def test_starvation_fires_once_at_the_limit_and_resets(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)

    def put(n, rows):
        df = spark.createDataFrame([(k, start + datetime.timedelta(seconds=t), c) for k, t, c in rows], "k string, t timestamp, c long")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")

    put(0, [("a", 0, 1), ("b", 0, 1), ("c", 0, 1)])
    put(1, [("a", 5, 1), ("b", 5, 2), ("z", 9, 0)])
    put(2, [("a", 12, 1), ("b", 12, 2), ("z", 12, 1)])  # a has stood for 12 seconds
    put(3, [("a", 14, 1), ("b", 14, 3), ("z", 15, 2)])
    put(4, [("a", 16, 2), ("b", 17, 3), ("z", 40, 3)])  # a moves, then both fall silent
    put(5, [("z", 60, 4)])
    put(6, [("z", 61, 5)])
    got = []
    for n in range(7):
        spark.read.parquet(f"{tmp_path}/in/{n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/seen")
        stream = incremental.read_growing(spark, f"{tmp_path}/seen", spark.read.parquet(f"{tmp_path}/in/0").schema, 1)
        q = incremental.starving(stream, "k", "t", "c", 10).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    def at(x):
        return int((x - start).total_seconds())

    found = sorted((r.k, r.c, at(r.since), at(r["at"]), r.silent) for r in got)
    # z moves with every row, but 25 and 20 seconds lie between some of them
    assert found == [("a", 1, 0, 10, False), ("a", 2, 16, 26, True), ("b", 3, 14, 24, False), ("c", 1, 0, 10, True), ("z", 2, 15, 25, True), ("z", 3, 40, 50, True)]
