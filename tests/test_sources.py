"""The SQLite stream: clocks, snapshots, restarts, odd values, tables without rowid; schema and header."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import rows
from tallyforge.sources import sqlitestream as source


def made(path, n=50, without=False):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL DEFAULT 'x', updated_at INTEGER, size REAL)" if not without else "CREATE TABLE t (id TEXT PRIMARY KEY, name TEXT, updated_at INTEGER, size REAL) WITHOUT ROWID")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i if not without else f"k{i}", f"n{i}", 100 + i, i / 2) for i in range(n)])
    return str(path)


def batch(spark, path, tmp_path, time="updated_at", **more):
    source.register(spark)
    reader = spark.readStream.format("sqlitestream").option("path", path).option("table", "t").option("snapshots", str(tmp_path / "snaps")).option("parts", "3")
    if time:
        reader = reader.option("time", time)
    seen = []
    q = reader.load().writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    return seen


def test_a_restart_reads_nothing_and_changes_come_once(spark, tmp_path):
    path = made(tmp_path / "s.db")
    assert sorted(r.id for r in batch(spark, path, tmp_path)) == list(range(50))
    assert batch(spark, path, tmp_path) == []
    with sqlite3.connect(path) as c:
        c.execute("INSERT INTO t VALUES (90, 'new', 10, 1)")
        c.execute("UPDATE t SET updated_at = 500, name = 'changed' WHERE id = 7")
    # 49 bears the last time seen, which may hide a change: it comes again
    assert sorted((r.id, r.name) for r in batch(spark, path, tmp_path)) == [(7, "changed"), (49, "n49"), (90, "new")]
    assert batch(spark, path, tmp_path) == []
    assert len(list((tmp_path / "snaps").iterdir())) <= 2


def test_all_partitions_see_one_state(tmp_path):
    path = made(tmp_path / "s.db")
    reader = source._Reader({"path": path, "table": "t", "snapshots": str(tmp_path / "snaps"), "time": "updated_at", "parts": "4"})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    got = list(reader.read(parts[0]))
    with sqlite3.connect(path) as c:
        c.execute("UPDATE t SET name = 'late'")
        c.execute("DELETE FROM t WHERE id > 20")
    for p in parts[1:]:
        got += reader.read(p)
    assert [(r[0], r[2]) for r in got] == [(i, f"n{i}") for i in range(50)] and len(parts) == 4
    assert reader.latestOffset() != end and reader.partitions(end, end) == []


def test_odd_values_and_no_rowid(spark, tmp_path):
    path = made(tmp_path / "s.db", 3)
    with sqlite3.connect(path) as c:
        c.execute("INSERT INTO t VALUES (10, x'ff00', 'soon', 'big')")
        c.execute("INSERT INTO t VALUES (11, 'ok', NULL, 2)")
    got = {r.id: r for r in batch(spark, path, tmp_path)}
    assert got[10].odd == {"name": "bytes:ff00", "updated_at": "str:soon", "size": "str:big"} and got[10].name is None
    assert got[11].odd == {} and got[11].size == 2.0 and got[11].updated_at is None and got[1].rowid == 1
    other = tmp_path / "b"
    other.mkdir()
    path = made(other / "w.db", 20, without=True)
    assert sorted(r.id for r in batch(spark, path, other)) == sorted(f"k{i}" for i in range(20))
    assert batch(spark, path, other) == []
    with sqlite3.connect(path) as c:
        c.execute("INSERT INTO t VALUES ('z', 'new', 119, 0)")
    assert sorted(r.id for r in batch(spark, path, other)) == ["k19", "z"]


def test_a_log_counts_as_a_change(spark, tmp_path):
    path = made(tmp_path / "s.db", 5)
    c = sqlite3.connect(path)
    c.execute("PRAGMA journal_mode=WAL")
    c.execute("INSERT INTO t VALUES (50, 'first', 1, 1)")
    c.commit()
    assert len(batch(spark, path, tmp_path, time=None)) == 6
    c.execute("INSERT INTO t VALUES (60, 'second', 1, 1)")
    c.commit()
    assert [r.id for r in batch(spark, path, tmp_path, time=None)] == [60]
    c.close()


def test_schema_extras_header(spark, tmp_path):
    path = made(tmp_path / "s.db", 1)
    with sqlite3.connect(path) as c:
        c.execute("CREATE INDEX by_name ON t (name)")
        c.execute("CREATE TABLE g (a INT, b INT GENERATED ALWAYS AS (a + 1))")
        c.execute("PRAGMA user_version = 7")
    rows = {(r.table, r.column): r for r in source.schema_of(spark, path).collect()}
    assert rows["t", "name"].notnull and rows["t", "name"].fallback == "'x'" and rows["t", "id"].pk == 1 and rows["g", "b"].hidden == 2 and rows["t", "id"].rowid
    assert {(r.kind, r.name) for r in source.extras_of(spark, path).collect()} == {("index", "by_name"), ("version", "7")}
    (tmp_path / "n.db").write_bytes(b"no")
    files = spark.read.format("binaryFile").load([path, str(tmp_path / "n.db")])
    assert {r.path.rsplit("/", 1)[1]: (r.sqlite, r.wal) for r in source.header(files).select("path", "sqlite", "wal").collect()} == {"s.db": (True, False), "n.db": (False, False)}
    with sqlite3.connect(path) as c:
        c.execute("PRAGMA journal_mode=WAL")
    assert source.header(spark.read.format("binaryFile").load(path)).select(F.col("wal")).first().wal


def test_plans_of_tables(spark, tmp_path):
    path = str(tmp_path / "p.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE threads (id TEXT PRIMARY KEY, cwd TEXT, rollout_path TEXT, updated_at INT, updated_at_ms INT)")
        c.execute("CREATE TABLE items (thread_id TEXT, n INT, turn_ordinal INT, updated_at_ordinal INT, PRIMARY KEY (thread_id, n)) WITHOUT ROWID")
        c.execute("CREATE TABLE logs (id INTEGER PRIMARY KEY AUTOINCREMENT, path TEXT, updated_at INT)")
        c.execute("CREATE TABLE bag (a INT)")
        c.execute("CREATE TABLE odd (a INT PRIMARY KEY, b INT GENERATED ALWAYS AS (a))")
        c.execute("CREATE TRIGGER t1 AFTER INSERT ON bag BEGIN SELECT 1; END")
        c.execute("CREATE TRIGGER t2 AFTER INSERT ON items BEGIN SELECT 1; END")
    plans = rows.key_plans(source.schema_of(spark, path))
    got = {r.table: (r.kind, r.key, r.version, r.time, r.paths, r.thread, r.ordinals, r.threads) for r in plans.collect()}
    assert got == {
        "threads": ("natural", ["id"], "updated_at_ms", "updated_at_ms", ["cwd", "rollout_path"], None, [], True),
        "items": ("natural", ["thread_id", "n"], "updated_at_ordinal", None, [], "thread_id", ["turn_ordinal"], False),
        "logs": ("surrogate", ["id"], "updated_at", None, ["path"], None, [], False), "bag": ("rowid", [], None, None, [], None, [], False), "odd": ("unsupported", ["a"], None, None, [], None, [], False),
    }
    safe = {r.table: r.safe for r in rows.insert_guard(plans, source.extras_of(spark, path), ["t2"]).collect()}
    assert safe == {"threads": True, "items": True, "logs": True, "bag": False, "odd": True}
    with pytest.raises(ValueError, match="more than 3"):
        rows.within(spark.range(5), 3)
    assert rows.within(spark.range(3), 3).count() == 3
