"""Reuse of what an earlier pass read: the ladder of decisions for a seat, digests behind an identity ledger, scans behind one.

An identity is the five columns of IDENTITY. What a ledger holds for the very same identity stands, and nothing is read for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ["dev", "ino", "size", "mtime_ns", "ctime_ns"]
POLICIES = ("never", "stale-only", "always")


def _id(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in IDENTITY])


def decide(seats: DataFrame, outputs: DataFrame, aliases: DataFrame, refused: DataFrame, exchange: bool = False, new_paths: str = "stream-local") -> DataFrame:
    """seats with decision and why: one ladder, the first rung that holds.

    seats: key, path, kind, the live file's identity (all five null where there is none), may_extend, captured (a capture record proves that the
    live file is this seat's), in_ledger (the source could offer a manifest without reading), sidecars (stale ones lie beside an absent database).
    outputs(key, path, identity...) is what was written before; aliases(key, earlier) names seats' keys under an old device number;
    refused(key, identity..., reason) what was refused before against that very live file.

    skip: a directory or link. reuse: by its own row, by an alias, or as captured. refuse: as remembered, with nothing read; but a missing exchange stands
    only while exchange is false, occupied or not-prefix not where the live file is one that outputs hold at that path, and occupied not where the
    file may be extended. Else want-manifest where the live path is taken or, by new_paths ('stream', 'manifest', 'stream-local'), where a
    row or the source's ledger knows the seat; else send. Repeated rows of a ledger count once.
    """
    if new_paths not in ("stream", "manifest", "stream-local"):
        raise ValueError(f"unknown way of new paths: {new_paths}")
    x = seats.withColumns({"_id": _id(), "_there": F.col("ino").isNotNull()})
    own = outputs.select("key", _id().alias("_id"))
    earlier = own.withColumnRenamed("key", "earlier").join(aliases.select("key", "earlier"), "earlier").select("key", "_id")
    hits = own.select("key", "_id", F.lit(2).alias("_n")).union(earlier.select("key", "_id", F.lit(1))).groupBy("key", "_id").agg(F.max("_n").alias("_hit"))
    placed = outputs.select("path", _id().alias("_id")).distinct().withColumn("_owned", F.lit(True))
    known = outputs.select("key").distinct().withColumn("_row", F.lit(True))
    no = refused.select("key", _id().alias("_id"), "reason").groupBy("key", "_id").agg(F.min("reason").alias("_no"))
    x = x.join(hits, ["key", "_id"], "left").join(no, ["key", "_id"], "left").join(placed, ["path", "_id"], "left").join(known, "key", "left")
    reason, owned = F.col("_no"), F.coalesce("_owned", F.lit(False))
    stands = (
        reason.isNotNull() & ~((reason == "exchange-unsupported") & F.lit(exchange)) & ~(reason.isin("occupied", "not-prefix") & owned) & ~((reason == "occupied") & F.coalesce("may_extend", F.lit(False)))
    )
    wished = F.lit(new_paths == "manifest") | F.lit(new_paths == "stream-local") & (F.coalesce("_row", F.lit(False)) | F.coalesce("in_ledger", F.lit(False)))

    def rung(decision: str, why: str | Column) -> Column:
        return F.struct(F.lit(decision).alias("decision"), (F.lit(why) if isinstance(why, str) else why).alias("why"))

    there = F.col("_there")
    ladder = (
        F.when(F.col("kind") != "regular", rung("skip", F.col("kind")))
        .when(there & (F.col("_hit") == 2), rung("reuse", "output"))
        .when(there & (F.col("_hit") == 1), rung("reuse", "alias"))
        .when(there & stands, rung("refuse", reason))
        .when(there & F.coalesce("captured", F.lit(False)), rung("reuse", "captured"))
        .when(~there & F.coalesce("sidecars", F.lit(False)), rung("refuse", "sidecars"))
        .when(there, rung("want-manifest", "occupied"))
        .when(wished, rung("want-manifest", "known"))
        .otherwise(rung("send", "new"))
    )
    return x.withColumn("_r", ladder).select(*seats.columns, "_r.decision", "_r.why")


def planned_reads(rows: DataFrame, digests: DataFrame, policy: str) -> DataFrame:
    """rows(kind, identity...) with held (the digest of a completed read of that very identity, else null) and read: whether the policy has the content read.

    never: no digest at all; stale-only: read what no digest is held for; always: read every regular file. digests(identity..., digest).
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown hash policy: {policy}")
    held = digests.groupBy(*IDENTITY).agg(F.max("digest").alias("held"))
    x = rows.join(held, IDENTITY, "left")
    regular = F.col("kind") == "regular"
    want = {"never": F.lit(False), "stale-only": regular & F.col("held").isNull(), "always": regular}[policy]
    shown = F.when(regular & F.lit(policy != "never"), F.col("held"))
    return x.select(*rows.columns, shown.alias("held"), want.alias("read"))


def hashed(rows: DataFrame, digests: DataFrame, policy: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows(path, kind, identity...) with digest and source ('held', 'read', or null without one). read turns the rows to be read into (path, digest)."""
    x = planned_reads(rows, digests, policy)
    new = read(x.where("read").select(*rows.columns)).select("path", F.col("digest").alias("_new"))
    x = x.join(new, "path", "left")
    return x.select(*rows.columns, F.when(F.col("read"), F.col("_new")).otherwise(F.col("held")).alias("digest"), F.when(F.col("read"), "read").when(F.col("held").isNotNull(), "held").alias("source"))


def walk_stats(rows: DataFrame, digests: DataFrame, policy: str) -> DataFrame:
    """One row: seats, bytes_seen (of regular files), bytes_read, fresh_skipped (a digest was held), reread (read although one was held)."""
    x = planned_reads(rows, digests, policy).join(digests.select(*IDENTITY).distinct().withColumn("_held", F.lit(True)), IDENTITY, "left")
    regular, fresh = F.col("kind") == "regular", F.coalesce("_held", F.lit(False)) & (F.col("kind") == "regular")

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col("size"))), F.lit(0)).cast("long")

    return x.agg(F.count("*").alias("seats"), total(regular).alias("bytes_seen"), total(F.col("read")).alias("bytes_read"), F.count_if(fresh).alias("fresh_skipped"), F.count_if(fresh & F.col("read")).alias("reread"))


class ScanCache:
    """Rows of files kept in a folder that all executors share, each under the identity that its file had.

    A pass writes the rows that it read, then the files that it read them of; what a broken pass left without that second table does not count.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _passes(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/files")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        marks = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(p.getName() for p in marks if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, passes: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{kind}/{p}" for p in passes])

    def scan(self, files: DataFrame, read: Callable[[DataFrame], DataFrame], racy: Column | None = None) -> DataFrame:
        """Rows of files(file, identity...), with cached: whether they come from an earlier pass.

        read turns the files to be opened into rows with a column file; it sees none whose identity stands. Files for which racy holds are read, but not
        remembered: their identity may outlive a change. file is distinct.
        """
        name, passes = uuid.uuid4().hex, self._passes()
        now = files.select("file", *IDENTITY)
        if passes:
            held = self._read("files", passes).select("file", *IDENTITY, "scan")
            # one scan stands for a file: two that ran side by side hold the same rows
            held = now.join(held, ["file", *IDENTITY]).groupBy("file").agg(F.max("scan").alias("scan"))
            stale = files.join(held, "file", "left_anti")
        else:
            held, stale = None, files
        rows = read(stale)
        rows.write.parquet(f"{self.folder}/rows/{name}")
        keep = stale if racy is None else stale.where(~F.coalesce(racy, F.lit(False)))
        keep.select("file", *IDENTITY, F.lit(name).alias("scan")).write.parquet(f"{self.folder}/files/{name}")
        fresh = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/{name}").withColumn("cached", F.lit(False))
        if held is None:
            return fresh
        old = None
        for p in passes:
            one = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/{p}").withColumn("scan", F.lit(p))
            old = one if old is None else old.unionByName(one)
        return old.join(held, ["file", "scan"]).drop("scan").withColumn("cached", F.lit(True)).unionByName(fresh)
