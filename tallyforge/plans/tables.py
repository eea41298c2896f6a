"""Reading the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
