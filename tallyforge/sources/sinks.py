"""Writing without losing what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.rows import latest


def publish(df: DataFrame, path: str) -> None:
    """Writes a new table; one that is there already is an error and stays."""
    df.write.mode("errorifexists").parquet(path)


def append_receipts(lines: DataFrame, path: str) -> None:
    """Adds one text line for each row of the single string column."""
    lines.write.mode("append").text(path)


def report(df: DataFrame, path: str) -> None:
    """A JSON document for each row."""
    df.write.mode("errorifexists").json(path)


def upserted(ledger: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The ledger with rows merged in: of each key the row with the highest order."""
    return latest(ledger.unionByName(rows), key, order)
