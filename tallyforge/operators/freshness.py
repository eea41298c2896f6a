"""Change detection between a snapshot and what was recorded before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], identity: list[str], size: str) -> DataFrame:
    """One row per class new / changed / fresh / vanished: n, bytes.

    Rows meet on key (null-safe); a row is fresh if every identity column is equal, null-safe.
    A vanished row counts with the size it had before. One full outer join, one aggregate.
    """
    a = before.select(*key, F.struct(*identity).alias("was"), F.col(size).alias("old_size"), F.lit(True).alias("in_a"))
    b = after.select(*key, F.struct(*identity).alias("now"), F.col(size).alias("new_size"), F.lit(True).alias("in_b"))
    on = None
    for k in key:
        one = a[k].eqNullSafe(b[k])
        on = one if on is None else on & one
    kind = (
        F.when(F.col("in_a").isNull(), "new")
        .when(F.col("in_b").isNull(), "vanished")
        .when(F.col("was").eqNullSafe(F.col("now")), "fresh")
        .otherwise("changed")
    )
    return (
        a.join(b, on, "full_outer")
        .select(kind.alias("kind"), F.coalesce("new_size", "old_size").alias("size"))
        .groupBy("kind")
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    )


def seat_state(rows: DataFrame, ledger: DataFrame, identity: list[str]) -> DataFrame:
    """rows with column state: fresh if the whole identity tuple is in the ledger, else stale.

    The ledger's tuples are made distinct first, so a row is never multiplied. A null identity
    column never matches.
    """
    held = ledger.select(*identity).distinct().withColumn("_held", F.lit(True))
    return rows.join(held, identity, "left").withColumn(
        "state", F.when(F.col("_held"), "fresh").otherwise("stale")
    ).drop("_held")


def racy(changed: Column, started: Column, tick: int, now: Column) -> Column:
    """True where a time stamp is too near the scan's start, or in the future, to be trusted."""
    return (changed >= started - F.lit(tick)) | (changed > now)
