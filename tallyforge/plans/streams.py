"""Streaming queries, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import incremental
from .catalogue import query
from .tables import table


@query(
    "stream_incremental",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 97 <> 0 GROUP BY 1",
)
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passes(spark, sf_dir, "event_id % 97 = 0")


@query(
    "stream_incremental_settled",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
)
def stream_incremental_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream_incremental, with the second pass that settles the rows the first one found too young."""
    return _passes(spark, sf_dir, "event_id % 97 = 0", None)


def _passes(spark: SparkSession, sf_dir: str, *racy_after: str | None) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    folder = incremental.work_folder(spark)
    for racy in racy_after:
        stream = incremental.read_growing(spark, f"{sf_dir}/events.parquet", schema).select("user_id", "event_id", "event_type", "value")
        incremental.upsert_batches(stream, f"{folder}/out", f"{folder}/log", ["user_id"], "event_id", racy_after=racy)
    return incremental.merged(spark, f"{folder}/out", ["user_id"], "event_id").select("user_id", F.col("event_id"), "event_type", "value")
