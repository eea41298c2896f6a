"""Reading a growing source once: marks, exactly-once merges, rows too young to trust."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.shared import shared_folder
from ..operators.rows import latest


def upsert_batches(source: DataFrame, target: str, checkpoint: str, key: list[str], order: str, racy_after: str | None = None) -> None:
    """Appends each micro-batch's latest rows per key to the table at `target`, then returns.

    A batch goes to a folder named by its number, written over when the batch is tried again: nothing
    is doubled after a failure. Rows for which racy_after holds (a condition) wait in a table beside the target,
    and every later pass first takes those for which its own condition no longer holds.
    """
    racy = F.coalesce(F.expr(racy_after), F.lit(False)) if racy_after else F.lit(False)
    _settle(source.sparkSession, target, key, order, racy)

    def put(batch: DataFrame, number: int) -> None:
        latest(batch.where(~racy), key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if racy_after:
            batch.where(racy).write.mode("overwrite").parquet(f"{target}-pending/batch={number}")

    source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _settle(spark: SparkSession, target: str, key: list[str], order: str, racy: Column) -> None:
    """Moves pending rows that are no longer racy to the target.

    Old folders go last: after a failure rows are there twice, which the latest row per key does not show.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{target}-pending")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
    # a folder without the mark is a write that failed, and its batch is tried again
    held = [p for p in held if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not held:
        return
    rows, name = spark.read.parquet(*[p.toString() for p in held]), uuid.uuid4().hex
    latest(rows.where(~racy), key, order).write.parquet(f"{target}/batch=settled-{name}")
    left = rows.where(racy)
    if not left.isEmpty():
        left.write.parquet(f"{target}-pending/batch=left-{name}")
    for p in held:
        files.delete(p, True)


def merged(spark: SparkSession, target: str, key: list[str], order: str) -> DataFrame:
    """The latest row per key over all batches at `target`."""
    return latest(spark.read.parquet(target).drop("batch"), key, order)


def read_growing(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 8) -> DataFrame:
    """A stream over Parquet files as they come, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stalled(stream: DataFrame, key: str, time: str, counter: str, seconds: int) -> DataFrame:
    """Streaming: per key and stretch of an unchanged counter, its rows, kept open for `seconds` without rows.

    Event-time sessions over (key, counter value): a stretch that lasts counts as a stall.
    """
    return (
        stream.withWatermark(time, f"{seconds} seconds")
        .groupBy(F.session_window(time, f"{seconds} seconds").alias("w"), key, counter)
        .agg(F.count("*").alias("n"))
        .select(key, counter, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def starving(stream: DataFrame, key: str, time: str, counter: str, seconds: int, delay: int = 0) -> DataFrame:
    """Streaming: (key, counter, since, at, silent) once for each stretch in which a key's counter did not move for `seconds`, at the limit.

    since: when the counter took its value; at: since and the limit; silent: no row had come since, so that the key may be gone rather than stuck. An event-time
    timer is set to the limit and set anew with every movement. Rows later than `delay` seconds behind the newest are dropped. time is a timestamp.
    """
    limit = seconds * 1000
    kind = dict(stream.dtypes)[key]

    def watch(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, since, seen, fired = state.get if state.exists else (None, None, None, False)
        out = []

        def alert() -> None:
            out.append((group[0], value, pd.Timestamp(since, unit="ms"), pd.Timestamp(since + limit, unit="ms"), seen == since))

        if state.hasTimedOut:
            if not fired:
                alert()
                fired = True
        else:
            rows = pd.concat(batches).sort_values([time, counter])
            for at, now in zip((rows[time].astype("datetime64[us]").astype("int64") // 1000).tolist(), rows[counter].tolist()):
                if value is not None and not fired and at - since >= limit:
                    alert()
                    fired = True
                if value is None or now != value:
                    value, since, fired = now, at, False
                seen = at
        state.update((value, since, seen, fired))
        if not fired:
            state.setTimeoutTimestamp(max(since + limit, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, counter, "since", "at", "silent"]).astype({"since": "datetime64[us]", "at": "datetime64[us]", "silent": bool})

    rows = stream.select(key, F.col(time), F.col(counter).cast("long").alias(counter)).withWatermark(time, f"{delay} seconds")
    return rows.groupBy(key).applyInPandasWithState(
        watch, f"{key} {kind}, {counter} long, since timestamp_ntz, at timestamp_ntz, silent boolean", "value long, since long, seen long, fired boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
