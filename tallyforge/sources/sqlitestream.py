"""A SQLite table as a stream: each batch is what two clocks, rowid and a time column, have not shown yet.

A pass reads one snapshot of the file, made by SQLite's own online backup into a folder that all executors share and named by the
file's identity: all partitions of a batch see the same state, and an unchanged file gives the same offset, so nothing is read.
Both clocks are part of the offset, which Spark keeps once a batch is through: they move only at the table's end.
"""

from __future__ import annotations

import hashlib
import os
import sqlite3
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

KINDS = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "DOUBLE": "double", "BLOB": "binary"}
FIRST = -(2**63)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    c.text_factory = lambda b: b.decode("utf-8", "surrogateescape")
    return c


def columns_of(c: sqlite3.Connection, table: str) -> list[tuple[str, str, int]]:
    """(name, kind, place in the primary key) of each column."""
    found = c.execute("SELECT name, type, pk FROM pragma_table_info(?)", [table]).fetchall()
    if not found:
        raise ValueError(f"no table {table}")
    return [(n, KINDS.get(t.upper(), "string"), pk) for n, t, pk in found]


def has_rowid(c: sqlite3.Connection, table: str) -> bool:
    return not c.execute("SELECT wr FROM pragma_table_list WHERE name = ? AND schema = 'main'", [table]).fetchone()[0]


def typed(value: object, kind: str) -> tuple[object, str | None]:
    """(the value as its column's kind, or null and how the odd one is written): SQLite holds any value in any column."""
    if value is None:
        return None, None
    if kind == "long" and isinstance(value, int) or kind == "binary" and isinstance(value, bytes):
        return value, None
    if kind == "double" and isinstance(value, int | float):
        return float(value), None
    if kind == "string" and isinstance(value, str):
        return value.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), None
    return None, f"{type(value).__name__}:{value.hex() if isinstance(value, bytes) else value}"


def identity(path: str) -> str:
    """Of a database file and its log: device, inode, size and time of change."""
    parts = []
    for p in (path, path + "-wal"):
        try:
            s = os.stat(p)
            # an empty log is none
            parts.append((s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns) if p == path or s.st_size else None)
        except FileNotFoundError:
            parts.append(None)
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:24]


class _Rows(InputPartition):
    def __init__(self, snapshot: str, where: str, values: list, order: str):
        self.snapshot, self.where, self.values, self.order = snapshot, where, values, order


class SqliteStream(DataSource):
    """Format "sqlitestream": options path, table, snapshots (a shared folder), time (a column that grows with every change; may be left out), parts.

    Rows: rowid (where the table has one), the columns, and odd, a map of those values that are not of their column's type. A row comes
    when its rowid is beyond the mark, or its time is at or beyond the last one. A table without rowid and time comes whole whenever the file changed.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlitestream"

    def schema(self) -> str:
        with opened(self.options["path"]) as c:
            columns = columns_of(c, self.options["table"])
            first = ["`rowid` long"] if has_rowid(c, self.options["table"]) else []
        return ", ".join([*first, *(f"`{n}` {k}" for n, k, _ in columns), "odd map<string,string>"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.folder = options["path"], options["table"], options["snapshots"]
        self.time, self.parts = options.get("time"), int(options.get("parts", "8"))

    def initialOffset(self) -> dict:
        return {"identity": "", "rowid": FIRST, "time": ""}

    def _file(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.db")

    def latestOffset(self) -> dict:
        name = identity(self.path)
        if not os.path.exists(self._file(name)):
            os.makedirs(self.folder, exist_ok=True)
            half = os.path.join(self.folder, uuid.uuid4().hex)
            with opened(self.path) as source, sqlite3.connect(half) as copy:
                source.backup(copy)
            os.replace(half, self._file(name))
        with opened(self._file(name)) as c:
            top = c.execute(f"SELECT max(rowid) FROM {quoted(self.table)}").fetchone()[0] if has_rowid(c, self.table) else None
            time = c.execute(f"SELECT max({quoted(self.time)}) FROM {quoted(self.table)}").fetchone()[0] if self.time else None
        # a time keeps its type: an offset holds texts and whole numbers
        return {"identity": name, "rowid": FIRST if top is None else top, "time": "" if time is None else repr(time)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start == end or start["identity"] == end["identity"]:
            return []
        with opened(self._file(end["identity"])) as c:
            rowid, columns = has_rowid(c, self.table), columns_of(c, self.table)
            after = _literal(start["time"])
            changed, values = [], []
            if rowid:
                changed, values = ["rowid > ?"], [start["rowid"]]
            if self.time and after is not None:
                changed, values = [*changed, f"{quoted(self.time)} >= ?"], [*values, after]
            elif self.time and not rowid:
                changed = []
            where = f"({' OR '.join(changed)})" if changed else "true"
            if not rowid:
                keys = [n for n, _, pk in sorted(columns, key=lambda x: x[2]) if any(n == m and p for m, _, p in columns)]
                return [_Rows(self._file(end["identity"]), where, values, ", ".join(map(quoted, keys)))]
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)} WHERE {where}", values).fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [_Rows(self._file(end["identity"]), f"rowid BETWEEN ? AND ? AND {where}", [a, min(a + step - 1, high), *values], "rowid") for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with opened(partition.snapshot) as c:
            columns, rowid = columns_of(c, self.table), has_rowid(c, self.table)
            names = ", ".join([*(["rowid"] if rowid else []), *(quoted(n) for n, _, _ in columns)])
            for row in c.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {partition.where} ORDER BY {partition.order}", partition.values):
                first, rest = (row[:1], row[1:]) if rowid else ((), row)
                made = [typed(v, k) for v, (_, k, _) in zip(rest, columns)]
                odd = {n: o for (_, o), (n, _, _) in zip(made, columns) if o is not None}
                yield (*first, *(v for v, _ in made), odd)

    def commit(self, end: dict) -> None:
        """Snapshots older than the one that is through go; a newer one may be the next batch's."""
        through = os.stat(self._file(end["identity"])).st_mtime_ns if os.path.exists(self._file(end["identity"])) else 0
        for f in os.scandir(self.folder):
            if f.name.endswith(".db") and f.stat().st_mtime_ns < through:
                os.unlink(f.path)


def _literal(text: str) -> object:
    import ast

    return ast.literal_eval(text) if text else None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteStream)


def schema_of(spark: SparkSession, path: str) -> DataFrame:
    """(table, rowid, sql, column, place, declared, notnull, fallback, pk, hidden): a row for each column of each table of the file, hidden ones too."""
    with opened(path) as c:
        tables = c.execute("SELECT name, wr FROM pragma_table_list WHERE schema = 'main' AND type = 'table' AND name NOT LIKE 'sqlite_%'").fetchall()
        sql = dict(c.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table'"))
        rows = [(t, not wr, sql.get(t), n, i, d, bool(nn), f, pk, h) for t, wr in tables for i, n, d, nn, f, pk, h in c.execute("SELECT cid, name, type, \"notnull\", dflt_value, pk, hidden FROM pragma_table_xinfo(?)", [t])]
    return spark.createDataFrame(rows, "table string, rowid boolean, sql string, column string, place int, declared string, notnull boolean, fallback string, pk int, hidden int")


def extras_of(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, table, sql): indexes, triggers and views, and one row of kind version with the file's user version as its name."""
    with opened(path) as c:
        rows = c.execute("SELECT type, name, tbl_name, sql FROM sqlite_master WHERE type <> 'table'").fetchall()
        rows.append(("version", str(c.execute("PRAGMA user_version").fetchone()[0]), None, None))
    return spark.createDataFrame(rows, "kind string, name string, table string, sql string")


def header(files: DataFrame, content: str = "content") -> DataFrame:
    """files with sqlite and wal: whether their first bytes are a database's, and one whose changes go to a log."""
    first = F.substring(content, F.lit(1), F.lit(16)) == F.lit(b"SQLite format 3\x00")
    logged = F.substring(content, F.lit(19), F.lit(2)) == F.lit(b"\x02\x02")
    return files.withColumn("sqlite", F.coalesce(first, F.lit(False))).withColumn("wal", F.coalesce(first & logged, F.lit(False)))
