"""State that outlives a table, a store and a pass: thread winners; and inserts under new keys, each exactly once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rows import union_threads
from .incremental import work_folder


@dataclass
class ThreadTable:
    """A table whose rows belong to threads: source rows in the order of `order`, and the destination's."""

    name: str
    source: DataFrame
    dest: DataFrame
    key: list[str]
    ordinal: str
    order: str


def carried(state: DataFrame, decided: DataFrame, thread: str) -> DataFrame:
    """(thread, winner): what this pass decided(thread, winner), else what state held before; a thread once held stays held."""
    old, new = state.select(thread, F.col("winner").alias("_old")), decided.select(thread, F.col("winner").alias("_new"))
    x = old.join(new, thread, "full_outer")
    return x.select(thread, F.when(F.col("_old") == "held", "held").otherwise(F.coalesce("_new", "_old")).alias("winner"))


def union_tables(state: DataFrame, tables: list[ThreadTable], thread: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(outcomes of each table by name, the new state): tables in their order of dependency, under the threads' winners.

    A thread that is held, from an earlier table, store or pass on, or from its first collision in this table, has all its rows held; and so in
    every later table. The outcomes and the state are written to the shared folder table by table.
    """
    spark, out = state.sparkSession, {}
    folder = work_folder(spark)
    state.write.parquet(f"{folder}/state-0")
    state = spark.read.schema(state.schema).parquet(f"{folder}/state-0")
    for n, t in enumerate(tables, 1):
        held = state.where("winner = 'held'").select(thread)
        free = union_threads(state.where("winner <> 'held'"), t.source.join(held, thread, "left_anti"), t.dest, thread, t.key, t.ordinal, t.order)
        rows = free.unionByName(t.source.join(held, thread, "left_semi").withColumn("outcome", F.lit("held")))
        rows.write.parquet(f"{folder}/outcomes-{n}")
        rows = out[t.name] = spark.read.schema(rows.schema).parquet(f"{folder}/outcomes-{n}")
        new = rows.where("outcome = 'held'").select(thread).distinct().withColumn("_held", F.lit(True))
        after = state.join(new, thread, "left").select(thread, F.when(F.col("_held"), "held").otherwise(F.col("winner")).alias("winner"))
        after.write.parquet(f"{folder}/state-{n}")
        state = spark.read.schema(after.schema).parquet(f"{folder}/state-{n}")
    return out, state


def applied(dest: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """The destination's rows after the outcomes: replaced ones as the source has them, inserted ones added, all others as they were."""
    written = outcomes.where("outcome in ('insert', 'replace')").select(*dest.columns)
    return dest.join(written.select(*key), key, "left_anti").unionByName(written)


class OnceInserted:
    """Rows whose key the destination gives anew, inserted exactly once although a key cannot tell a row inserted before.

    A batch is pending in the ledger before its rows are written, and confirmed after. What a broken run left pending is settled by content: as many of
    the pending rows of a content as the table holds beyond those confirmed were written and are confirmed; the others are still to be inserted.
    """

    def __init__(self, spark: SparkSession, folder: str, content: list[str], key: str = "id"):
        self.spark, self.folder, self.content, self.key = spark, folder.rstrip("/"), content, key

    def _parts(self, kind: str) -> list[str]:
        """Whole batches of a kind: a folder without the mark is a write that failed."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        return [p.toString() for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _read(self, kind: str, schema) -> DataFrame:
        parts = self._parts(kind)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def rows(self, schema) -> DataFrame:
        """The table: key and content."""
        return self._read("rows", f"{self.key} long, " + ", ".join(f"{c} {dict(schema)[c]}" for c in self.content))

    def insert(self, new: DataFrame, fail_after: str | None = None) -> int:
        """Inserts new(source, ordinal, content...), each (source, ordinal) once over all calls; says how many rows were written. fail_after: 'pending' or 'rows', for tests."""
        types, batch = new.dtypes, uuid.uuid4().hex
        ledger = f"source {dict(types)['source']}, ordinal {dict(types)['ordinal']}, " + ", ".join(f"{c} {dict(types)[c]}" for c in self.content)
        self._settle(types, ledger)
        done = self._read("confirmed", ledger).select("source", "ordinal")
        todo = new.select("source", "ordinal", *self.content).dropDuplicates(["source", "ordinal"]).join(done, ["source", "ordinal"], "left_anti")
        todo.write.parquet(f"{self.folder}/pending/{batch}")
        todo = self.spark.read.schema(ledger).parquet(f"{self.folder}/pending/{batch}")
        if fail_after == "pending":
            raise RuntimeError("stopped before the rows")
        top = self.rows(types).agg(F.max(self.key)).first()[0] or 0
        # new keys: the place in the order of the ledger, in blocks of the sort's tasks
        placed = todo.orderBy("source", "ordinal").withColumn("_at", F.monotonically_increasing_id())
        placed.write.parquet(f"{self.folder}/placed/{batch}")
        placed = self.spark.read.parquet(f"{self.folder}/placed/{batch}").withColumn("_part", F.shiftright("_at", 33))
        starts, at = [], top + 1
        for part, n in sorted(map(tuple, placed.groupBy("_part").agg(F.count("*")).collect())):  # one row for each task of the sort
            starts.append((part, at))
            at += n
        keys = placed.join(F.broadcast(self.spark.createDataFrame(starts, "_part long, _start long")), "_part")
        keys.select((F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(self.key), *self.content).write.parquet(f"{self.folder}/rows/{batch}")
        if fail_after == "rows":
            raise RuntimeError("stopped before the ledger")
        todo.write.parquet(f"{self.folder}/confirmed/{batch}")
        return at - top - 1

    def _settle(self, types, ledger: str) -> None:
        """Confirms pending rows that were written, by content, and forgets the other claims."""
        confirmed, pending = self._read("confirmed", ledger), self._read("pending", ledger)
        open_ = pending.dropDuplicates(["source", "ordinal"]).join(confirmed.select("source", "ordinal"), ["source", "ordinal"], "left_anti")
        if open_.isEmpty():
            return
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"h.{c}")) for c in self.content]
        have = self.rows(types).groupBy(*self.content).agg(F.count("*").alias("_have"))
        used = confirmed.groupBy(*self.content).agg(F.count("*").alias("_used"))
        spare = have.alias("o").join(used.alias("h"), same, "left").select(*[F.col(f"o.{c}").alias(c) for c in self.content], (F.col("_have") - F.coalesce("_used", F.lit(0))).alias("_spare"))
        ranked = open_.withColumn("_n", F.row_number().over(W.partitionBy(*self.content).orderBy("source", "ordinal")))
        written = ranked.alias("o").join(spare.alias("h"), same).where("_n <= _spare").select("source", "ordinal", *[F.col(f"o.{c}").alias(c) for c in self.content])
        written.write.parquet(f"{self.folder}/confirmed/settled-{uuid.uuid4().hex}")
