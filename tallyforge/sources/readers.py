"""Sources that Spark has no reader for: file trees, SQLite tables, compressed JSON lines."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TREE = "path binary, kind string, dev long, ino long, size long, mtime_ns long, ctime_ns long, mode int, nlink long, link_target binary, refusal string"


class _Part(InputPartition):
    def __init__(self, value: object):
        self.value = value


class FileTree(DataSource):
    """Format "filetree": a row for each entry below `path`; one partition for each entry of the top directory.

    The path must be reachable from every executor. Names are bytes. A link is a row and not followed; an entry
    that cannot be read is a row with a refusal, and so is what lies deeper than `deepest`.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.fsencode(options["path"])
        self.deepest = int(options.get("deepest", "256"))

    def partitions(self) -> list[InputPartition]:
        try:
            return [_Part(n) for n in sorted(os.listdir(self.root))] or [_Part(None)]
        except OSError as e:
            return [_Part(e.errno)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if isinstance(partition.value, int):
            yield (b"", "directory", *[None] * 8, f"io:{partition.value}")
        elif partition.value is not None:
            yield from self._walk(partition.value, 1)

    def _walk(self, rel: bytes, depth: int) -> Iterator[tuple]:
        full = os.path.join(self.root, rel)
        try:
            s = os.lstat(full)
        except OSError as e:
            yield (rel, "other", *[None] * 8, f"io:{e.errno}")
            return
        names, gone = [], None
        if s.st_mode & 0o170000 == 0o040000 and depth < self.deepest:
            try:
                names = sorted(os.listdir(full))
            except OSError as e:  # unreadable, or vanished since
                gone = f"io:{e.errno}"
        kind = {0o100000: "regular", 0o040000: "directory", 0o120000: "symlink"}.get(s.st_mode & 0o170000, "other")
        target = os.readlink(full) if kind == "symlink" else None
        refusal = "kind" if kind == "other" else "too-deep" if kind == "directory" and depth >= self.deepest else "too-long" if len(rel) > 4095 else gone
        yield (rel, kind, s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_mode, s.st_nlink, target, refusal)
        if kind == "directory" and refusal is None:
            for n in names:
                yield from self._walk(os.path.join(rel, n), depth + 1)


class SqliteTable(DataSource):
    """Format "sqlitetable": rows of table `table` in the file `path`, in `parts` ranges of rowid.

    after_rowid leaves out what an earlier pass has read. Each partition reads in one transaction.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlitetable"

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "BLOB": "binary"}
        with self._open() as c:
            columns = c.execute("SELECT name, type FROM pragma_table_info(?)", [self.options["table"]]).fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(["rowid long", *(f"`{n}` {kinds.get(t.upper(), 'string')}" for n, t in columns)])

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, [f.name for f in schema.fields])


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = dict(options), columns

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def _name(self, x: str) -> str:
        return '"' + x.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        after = int(self.options.get("after_rowid", str(-(2**63))))
        with self._open() as c:
            a, b = c.execute(f"SELECT min(rowid), max(rowid) FROM {self._name(self.options['table'])} WHERE rowid > ?", [after]).fetchone()
        if a is None:
            return [_Part((1, 0))]
        step = -(-(b - a + 1) // int(self.options.get("parts", "8")))
        return [_Part((x, min(x + step - 1, b))) for x in range(a, b + 1, step)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        names = ", ".join(["rowid", *map(self._name, self.columns[1:])])
        with self._open() as c:
            yield from c.execute(f"SELECT {names} FROM {self._name(self.options['table'])} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", partition.value)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    spark.dataSource.register(FileTree)
    spark.dataSource.register(SqliteTable)


def json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, pos, line): lines of JSONL files, plain or zstd-compressed; whole is false for a last line without its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if data[:4] == b"\x28\xb5\x2f\xfd":
                    data = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
                lines = data.split(b"\n")
                tail = lines.pop()
                whole = [True] * len(lines) + ([False] if tail else [])
                lines += [tail] if tail else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines]), pa.array(whole, pa.bool_())],
                    ["path", "pos", "line", "whole"],
                )

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, pos long, line string, whole boolean")


def key_values(lines: DataFrame, column: str) -> DataFrame:
    """Adds values: a map of the `key=value` words of a line; `unknown` is null; of a repeated key the last value counts."""
    pairs = F.filter(F.split(column, r"\s+"), lambda x: x.contains("="))
    each = F.transform(pairs, lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.nullif(F.split(x, "=", 2)[1], F.lit("unknown")).alias("v")))
    last = F.filter(each, lambda x, i: ~F.exists(F.slice(each, i + 2, F.size(each)), lambda y: y["k"] == x["k"]))
    made = F.map_from_entries(last)
    return lines.withColumn("values", made)
